"""Byte-level BPE of whole texts, with tree concatenation for long ones.

Texts of up to `chunk` characters are encoded as they are. Longer texts are cut into halves until
the pieces are short; the pieces are rows of their own, so tasks encode them in parallel, and are
then joined as a tree. At a join only the surroundings are encoded again:

* Some places always separate tokens, whatever stands around them: after a letter run, after a
  digit run, and between other text and white space. What lies outside the nearest such places on
  both sides of the join is settled.
* What lies between them is split by the tokenizer's pattern. If one unsplit run crosses the join,
  a window of tokens around it is encoded again and doubled until its first and last tokens fit
  the neighbours outside it. A sequence of tokens is the encoding of a run exactly if every
  adjacent pair is (the encoding of the pair's bytes gives the pair), so the joined sequence is
  the encoding of the whole run.

The special string of the vocabulary separates texts like the tokenizers library does. Encoding
is always that of the whole text: pieces of a pattern never change the result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliograph.llm.common import packed, slices, table, unpacked

# Fixed values of the vocabulary: its split pattern, and its special string with the id.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = ("<|endoftext|>", 50256)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Codec:
    """Encoder and decoder over a rank file (base64 token, rank)."""

    def __init__(self, ranks_path: str, pattern: str = PATTERN, special: tuple[str, int] | None = SPECIAL):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.special = special
        self.bytes_of = [b""] * (max([*ranks.values(), special[1] if special else 0]) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        if special:
            self.bytes_of[special[1]] = special[0].encode()
        self.lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.boundary = regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})|(?<=\S)(?=\s)")
        self.boundary_back = regex.compile(r"(?r)(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})|(?<=\S)(?=\s)")

    def run(self, raw: bytes) -> list[int]:
        """Ids of one unsplit run."""
        return self.core._encode_single_piece(raw)

    def ordinary(self, text: str) -> list[int]:
        return self.core.encode_ordinary(text)

    def segments(self, text: str) -> list[str]:
        """Parts of text between the special strings."""
        return text.split(self.special[0]) if self.special else [text]

    def text(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def join_segments(self, parts: list[np.ndarray]) -> np.ndarray:
        out = [parts[0]]
        for part in parts[1:]:
            out += [np.array([self.special[1]], dtype=np.int32), part]
        return np.concatenate(out)

    def _pair_fits(self, a: int, b: int) -> bool:
        return self.run(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join_runs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the run whose halves have the ids left and right."""
        width = 1
        while True:
            a, b = left[max(0, len(left) - width):], right[:width]
            again = self.run(b"".join(map(self.bytes_of.__getitem__, [*a, *b])))
            starts = width >= len(left) or self._pair_fits(int(left[-width - 1]), again[0])
            ends = width >= len(right) or self._pair_fits(again[-1], int(right[width]))
            if starts and ends:
                return np.concatenate([left[: len(left) - len(a)], np.array(again, dtype=np.int32), right[len(b):]])
            width *= 2

    def _long_run(self, raw: bytes, limit: int) -> np.ndarray:
        if len(raw) <= limit:
            return np.array(self.run(raw), dtype=np.int32)
        half = len(raw) // 2
        return self.join_runs(self._long_run(raw[:half], limit), self._long_run(raw[half:], limit))

    def join(self, left: tuple[str, np.ndarray], right: tuple[str, np.ndarray], limit: int = 4096) -> tuple[str, np.ndarray]:
        """(text, ids) of the concatenation of two texts with their ids."""
        (a, left_ids), (b, right_ids) = left, right
        if not a or not b:
            return a + b, left_ids if a else right_ids
        # Settled places before and after the join; those at the cut itself need both texts to be seen.
        start = next((m.start() for m in self.boundary_back.finditer(a) if m.start() < len(a)), 0)
        found = self.boundary.search(b, 1)
        end = found.start() if found else len(b)
        middle = a[start:] + b[:end]
        # One character of what follows is enough for the pattern to end its last piece here.
        after = b[end:end + 2]
        pieces, at = [], start
        for piece in self.pattern.findall(middle + after):
            if at >= len(a) + end:
                break
            pieces.append((at, piece))
            at += len(piece)
        ids: list[np.ndarray] = []
        for at, piece in pieces:
            raw = piece.encode()
            cut = len(a) - at
            if len(raw) <= limit:
                ids.append(np.array(self.run(raw), dtype=np.int32))
            elif 0 < cut < len(piece) and self._is_own_run(a[start:], a[at:]) and self._leads(b, piece[cut:]):
                head = self._tail_ids(left_ids, len(a[at:].encode()))
                tail = self._head_ids(right_ids, len(piece[cut:].encode()))
                ids.append(self.join_runs(head, tail))
            else:
                ids.append(self._long_run(raw, limit))
        kept_left = left_ids[: len(left_ids) - len(self._tail_ids(left_ids, len(a[start:].encode())))]
        kept_right = right_ids[len(self._head_ids(right_ids, len(b[:end].encode()))):]
        return a + b, np.concatenate([kept_left, *ids, kept_right])

    def _is_own_run(self, settled: str, tail: str) -> bool:
        """Whether the left text, seen alone, also ends with the run `tail`."""
        last = ""
        for last in self.pattern.findall(settled):
            pass
        return last == tail

    def _leads(self, text: str, head: str) -> bool:
        """Whether the right text, seen alone, also begins with the run `head`."""
        return self.pattern.match(text).group() == head

    def _tail_ids(self, ids: np.ndarray, n_bytes: int) -> np.ndarray:
        ends = np.cumsum(self.lengths[ids[::-1]])
        at = int(np.searchsorted(ends, n_bytes)) if n_bytes else -1
        if n_bytes and (at >= len(ends) or ends[at] != n_bytes):
            raise ValueError("no token boundary at a settled place")
        return ids[len(ids) - at - 1:]

    def _head_ids(self, ids: np.ndarray, n_bytes: int) -> np.ndarray:
        ends = np.cumsum(self.lengths[ids])
        at = int(np.searchsorted(ends, n_bytes)) if n_bytes else -1
        if n_bytes and (at >= len(ends) or ends[at] != n_bytes):
            raise ValueError("no token boundary at a settled place")
        return ids[: at + 1]

    def join_all(self, parts: list[tuple[str, np.ndarray]]) -> np.ndarray:
        """Ids of a text from those of its consecutive parts, joined as a tree."""
        while len(parts) > 1:
            parts = [
                self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)
            ]
        return parts[0][1]

    def encode(self, text: str, chunk: int = 8192) -> np.ndarray:
        """The same tree in one process."""
        parts = []
        for segment in self.segments(text):
            halves = cut(segment, chunk)
            parts.append(self.join_all([(x, np.array(self.ordinary(x), dtype=np.int32)) for x in halves]))
        return self.join_segments(parts)


@functools.lru_cache(maxsize=2)
def codec(ranks_path: str) -> Codec:
    return Codec(ranks_path)


def cut(text: str, chunk: int) -> list[str]:
    """Halves of text, and their halves, until none is longer than chunk."""
    if len(text) <= chunk:
        return [text]
    half = len(text) // 2
    return cut(text[:half], chunk) + cut(text[half:], chunk)


def _list_array(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    values = np.concatenate(rows).astype(np.int32, copy=False) if rows else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _with(batch: pa.RecordBatch, drop: str, name: str, values: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != drop]
    return pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], values], names=[*names, name])


def encode(
    docs: DataFrame, text_col: str = "text", ranks_path: str | None = None, chunk: int = 32768
) -> DataFrame:
    """docs as {doc: all columns but the text, ids: array<int>}. A null text is an empty one and has no
    ids; rows that repeat come back as often; an empty table gives an empty table; no name of a column
    can clash, and without other columns doc is null."""
    ranks_path = ranks_path or default_ranks()
    rows = packed(docs, text_col, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("body"))
    doc_type = rows.schema["doc"].dataType
    out = T.StructType([T.StructField("doc", doc_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path)
        for batch in slices(batches):
            found = [
                np.array(c.ordinary(x), dtype=np.int32) if c.special[0] not in x
                else c.join_segments([np.array(c.ordinary(s), dtype=np.int32) for s in c.segments(x)])
                for x in batch.column("body").to_pylist()
            ]
            yield _with(batch, "body", "ids", _list_array(found))

    encoded = rows.filter(F.char_length("body") <= chunk).mapInArrow(short, out)
    return unpacked(encoded.union(_encode_long(rows.filter(F.char_length("body") > chunk), out, ranks_path, chunk)))


def _encode_long(rows: DataFrame, out: T.StructType, ranks_path: str, chunk: int) -> DataFrame:
    """The distributed tree: pieces of long texts are rows; a text's pieces meet in one group."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path)
        for batch in batches:
            for i, text in enumerate(batch.column("body").to_pylist()):
                key, doc = _digest(text), batch.column("doc").slice(i, 1)
                for s, segment in enumerate(c.segments(text)):
                    for p, piece in enumerate(cut(segment, chunk)):
                        first = s == 0 and p == 0
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([key]), pa.array([s], pa.int32()), pa.array([p], pa.int32()), pa.array([piece]),
                                pa.ListArray.from_arrays(pa.array([0, int(first)], pa.int32()), doc if first else doc.slice(0, 0)),
                            ],
                            names=["key", "segment", "piece", "body", "docs"],
                        )

    doc_type = out["doc"].dataType
    piece_type = T.StructType([
        T.StructField("key", T.StringType()), T.StructField("segment", T.IntegerType()),
        T.StructField("piece", T.IntegerType()), T.StructField("body", T.StringType()),
        T.StructField("docs", T.ArrayType(doc_type)),
    ])
    spread = rows.mapInArrow(pieces, piece_type)
    owners = spread.filter(F.size("docs") > 0).select("key", F.explode("docs").alias("doc"))
    # Equal texts give equal pieces: each is encoded once.
    unique = spread.select("key", "segment", "piece", "body").dropDuplicates(["key", "segment", "piece"])

    def encode_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path)
        for batch in batches:
            found = [np.array(c.ordinary(x), dtype=np.int32) for x in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, _list_array(found)], names=[*batch.schema.names, "ids"])

    part_type = T.StructType([*piece_type.fields[:4], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    parts = unique.mapInArrow(encode_piece, part_type)

    def joined(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        c = codec(ranks_path)
        group = group.sort_by([("segment", "ascending"), ("piece", "ascending")])
        segments: dict[int, list] = {}
        ids = group.column("ids").combine_chunks()
        for i, (s, body) in enumerate(zip(group.column("segment").to_pylist(), group.column("body").to_pylist(), strict=True)):
            segments.setdefault(s, []).append((body, np.asarray(ids[i].values, dtype=np.int32)))
        whole = c.join_segments([c.join_all(p) for p in segments.values()])
        return pa.table({"key": [key[0].as_py()], "ids": _list_array([whole])})

    whole = parts.groupBy("key").applyInArrow(joined, "key string, ids array<int>")
    return owners.join(whole, "key").select("doc", "ids")


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode(), digest_size=16).hexdigest()


def decode(df: DataFrame, ids_col: str = "ids", name: str = "decoded", ranks_path: str | None = None) -> DataFrame:
    """df with the text of its ids; special ids give their string. Null ids give an empty text."""
    ranks_path = ranks_path or default_ranks()
    out = T.StructType([*df.schema.fields, T.StructField(name, T.StringType())])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path)
        for batch in slices(batches):
            ids = batch.column(ids_col)
            values, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            found = [c.text(values[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, name])

    return df.mapInArrow(texts, out)


def digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    tokens = decode(encode(docs.select("doc_id", "text")))
    return tokens.select(
        "doc.doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
