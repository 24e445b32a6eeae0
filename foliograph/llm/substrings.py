"""Suffix-array dedup: bytes inside long strings that also start earlier are removed.

Sorting every suffix is not needed to find repeats of `length` bytes. Every such string contains an
anchor: the place of the least hash among its GRAM-byte grams, which depends on its bytes alone. Two
occurrences of a string therefore have their anchors at the same offset, and only suffixes that
start at anchors whose gram repeats are sorted.

1. Anchors of all texts are dealt out by gram, with a hash of the whole surroundings in which strings
   with this anchor can lie. Of equal surroundings only the earliest matters for others; the later
   ones are covered as a whole. Grams with one kind of surroundings are done.
2. Suffixes at the remaining anchors are sorted by each task that reads texts, front-coded (length of
   the prefix shared with the one before, and the rest) and exchanged as runs.
3. Runs are merged by a loser tree that keeps, for each run's head, the prefix it shares with the last
   suffix put out: heads with different shared lengths are ordered without looking at bytes, and
   equal ones are compared from there on. The merged order has its common-prefix lengths.
4. A string with `o` bytes before the anchor equals another if the suffixes share length - o bytes and
   the bytes before share o. Ranks at those depths follow from common-prefix lengths; for each o, all
   but the earliest of equal strings are covered.
5. A gram with more than `most` kinds of surroundings (a short template, in ever other text) would make one
   merge grow with the corpus. Its strings are told apart by two hashes of 64 bits each instead, with
   the earliest as a combined minimum.
6. Covered stretches of a document are joined and cut out.

Defined cases: a null text is an empty one; a null id counts as the smallest integer; rows that repeat
an id with the same text are one document (both get its result), with other texts they are documents
in the order of the texts' hashes; texts shorter than `length` bytes lose nothing; other columns come
back unchanged in `doc`. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import packed, partitions, slices, stored, table, unpacked

LENGTH, GRAM = 100, 24
FACTOR = 0x9E3779B97F4A7C15 | 1
GAP = b"\xff"  # never part of UTF-8: stands for what lies outside a text
SEGMENT = 1 << 21
MOST_KINDS = 8192  # kinds of surroundings of a gram that one merge takes
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

FACTOR_2 = 0xC2B2AE3D27D4EB4F | 1
_BYTES_2 = np.random.default_rng(20240230).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(FACTOR, n, 1 << 64))


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best of each `width` consecutive values, by doubling."""
    out, have = values, 1
    while 2 * have <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    return best(out[: len(values) - width + 1], out[width - have: width - have + len(values) - width + 1]) if have < width else out


def anchors(raw: np.ndarray, inside: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, gram hashes, hashes of surroundings) of the anchors of texts that lie in `raw` with gaps of
    `length` bytes around them. inside: where a string of `length` bytes lies within one text."""
    hashed = _BYTES[raw]
    by = {1: hashed}
    for k in (1, 2, 4, 8):
        by[2 * k] = by[k][:-k] * _power(k) + by[k][k:]
    grams = by[16][: len(raw) - GRAM + 1] * _power(8) + by[8][16: 16 + len(raw) - GRAM + 1]
    width = length - GRAM + 1
    least = _sliding(grams, width, np.minimum)
    n = len(least)
    least[~inside[:n]] = 0
    # A gram is an anchor if it is the least of some string: pad so that every place sees all strings around it.
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    most = _sliding(padded, width, np.maximum)
    places = np.flatnonzero((most == grams) & (most != 0))
    before, total = length - GRAM, 2 * length - GRAM
    around = np.zeros(len(places), np.uint64)
    at = 0
    while at + 16 <= total:
        around = around * _power(16) + by[16][places - before + at]
        at += 16
    while at < total:
        around = around * _power(1) + hashed[places - before + at]
        at += 1
    return places, grams[places], around


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[tuple[int, int, int, int]], bytes]]:
    """Buffers of about SEGMENT bytes: ([(text, its first byte here, first and last own place)], bytes).
    Long texts come in overlapping pieces, each of which owns the anchors of its middle."""
    gap, parts, here, size = GAP * length, [], [], 0

    def done():
        return here, gap + gap.join(parts) + gap

    margin = 3 * length
    for number, text in enumerate(texts):
        if len(text) < length:
            continue
        for start in range(0, len(text), SEGMENT):
            end = min(start + SEGMENT, len(text))
            low, high = max(0, start - margin), min(len(text), end + margin)
            here.append((number, low, start, end))
            parts.append(text[low:high])
            size += high - low
            if size >= SEGMENT:
                yield done()
                parts, here, size = [], [], 0
    if parts:
        yield done()


def text_anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text number, place in bytes, gram, surroundings) of all anchors."""
    found = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]]
    for here, joined in _pieces(texts, length):
        raw = np.frombuffer(joined, dtype=np.uint8)
        gaps = np.flatnonzero(raw == 0xFF)
        stop = np.concatenate([gaps, [len(raw)]])[np.searchsorted(gaps, np.arange(len(raw)))]
        inside = (raw != 0xFF) & (stop - np.arange(len(raw)) >= length)
        places, grams, around = anchors(raw, inside, length)
        starts, at = [], length
        for number, low, _, end in here:
            starts.append(at)
            at += min(len(texts[number]), end + 3 * length) - low + length
        which = np.searchsorted(starts, places, side="right") - 1
        numbers, lows, own_from, own_to = (np.array(x)[which] for x in zip(*here, strict=True))
        local = places - np.array(starts)[which] + lows
        own = (local >= own_from) & (local < own_to)
        for column, values in zip(found, (numbers, local, grams, around), strict=True):
            column.append(values[own])
    return tuple(np.concatenate(x) for x in found)


def shared(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, of which `known` bytes are known."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_code(suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(shared lengths, rest lengths, rests) of sorted suffixes."""
    common = [0] + [shared(a, b, 0) for a, b in zip(suffixes[:-1], suffixes[1:], strict=True)]
    rests = [s[c:] for s, c in zip(suffixes, common, strict=True)]
    return np.array(common, np.int32), np.array([len(r) for r in rests], np.int32), b"".join(rests)


def front_decode(common, sizes, rests: bytes) -> Iterator[tuple[bytes, int]]:
    last, at = b"", 0
    for c, n in zip(common.tolist(), sizes.tolist(), strict=True):
        last = last[:c] + rests[at:at + n]
        at += n
        yield last, c


def merge(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, bytes, int]]:
    """Sorted (run, suffix, prefix shared with the one before) of sorted runs of (suffix, prefix shared
    with the one before in its run): a loser tree whose entries know the prefix they share with the
    winner that passed them."""
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[bytes | None] = [None] * k
    lcps = [0] * k
    for i, run in enumerate(runs):
        heads[i] = next(run, (None, 0))[0]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared length becomes that with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if lcps[a] != lcps[b]:
            return (a, b) if lcps[a] > lcps[b] else (b, a)
        h = shared(x, y, lcps[a])
        a_first = h == len(x) or (h < len(y) and x[h] < y[h])
        winner, loser = (a, b) if a_first else (b, a)
        lcps[loser] = h
        return winner, loser

    losers = [-1] * k
    winners = [-1] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if k > 1 else 0
    while heads[best] is not None:
        yield best, heads[best], lcps[best]
        heads[best], lcps[best] = next(runs[best], (None, 0))
        node = (best + k) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2


def covered_offsets(common: np.ndarray, sizes: np.ndarray, before: list[bytes], order: np.ndarray, length: int) -> np.ndarray:
    """(suffixes, offsets) matrix: whether the string that starts `offset` bytes before the suffix is covered.

    common, sizes: shared prefix lengths and lengths of the sorted suffixes; before: the bytes before each,
    nearest first; order: rank of each by document and place."""
    n = len(sizes)
    gram = np.cumsum(common < GRAM)
    by_left = sorted(range(n), key=lambda i: (gram[i], before[i]))
    left_common = np.array([0] + [
        shared(before[a], before[b], 0) if gram[a] == gram[b] else -1 for a, b in zip(by_left[:-1], by_left[1:], strict=True)
    ])
    by_left = np.array(by_left)
    left_sizes = np.array([len(b) for b in before])
    covered = np.zeros((n, length - GRAM + 1), dtype=bool)
    for o in range(length - GRAM + 1):
        right = np.cumsum(common < length - o)
        left = np.empty(n, np.int64)
        left[by_left] = np.cumsum(left_common < o) if o else np.cumsum(left_common < 0)
        valid = np.flatnonzero((sizes >= length - o) & (left_sizes >= o))
        key = right[valid] * (n + 1) + left[valid]
        by_key = np.lexsort((order[valid], key))
        later = np.concatenate([[False], key[by_key][1:] == key[by_key][:-1]])
        covered[valid[by_key[later]], o] = True
    return covered


_MARKS = "later boolean, doc long, variant long, place int, gram long"
_MARK_SCHEMA = pa.schema([("later", pa.bool_()), ("doc", pa.int64()), ("variant", pa.int64()), ("place", pa.int32()), ("gram", pa.int64())])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From anchors sorted by (gram, around, doc, variant, place): those that are later of their kind, and
    the first of each kind of grams with several kinds."""
    last = None  # the last row
    pending = np.zeros((5, 0), np.int64)  # the first of a gram that has no second yet
    going_on = None  # a gram of several kinds that may go on

    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("gram", "around", "doc", "variant", "place")])
        if not rows.shape[1]:
            continue
        prior = np.concatenate([(rows[:, :1] if last is None else last), rows[:, :-1]], axis=1)
        same = np.cumprod(rows == prior, axis=0).astype(bool)  # equal up to each column
        if last is None:
            same[:, 0] = False
        later = rows[:, same[1] & ~same[4]]
        last = rows[:, -1:]
        firsts = np.concatenate([pending, rows[:, ~same[1]]], axis=1)
        several = _several(firsts[0])
        if going_on is not None:
            several |= firsts[0] == going_on
        if firsts.shape[1]:
            pending, going_on = (firsts[:, :0], int(firsts[0, -1])) if several[-1] else (firsts[:, -1:], None)
        firsts = firsts[:, several]
        flags = np.repeat([True, False], [later.shape[1], firsts.shape[1]])
        yield _mark_batch(np.concatenate([later, firsts], axis=1), flags)


def _several(grams: np.ndarray) -> np.ndarray:
    """Which entries of a sorted array have an equal neighbour."""
    equal = grams[1:] == grams[:-1]
    return np.concatenate([[False], equal]) | np.concatenate([equal, [False]]) if len(grams) else np.zeros(0, bool)


def _mark_batch(rows: np.ndarray, later: np.ndarray) -> pa.RecordBatch:
    gram, _, doc, variant, place = rows
    columns = [pa.array(later), pa.array(doc), pa.array(variant), pa.array(place.astype(np.int32)), pa.array(np.where(later, 0, gram))]
    return pa.RecordBatch.from_arrays(columns, schema=_MARK_SCHEMA)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with their document's key (doc, variant) and text."""
    own = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63)))
    body = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    repeats = docs.select(own.alias("doc")).groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    variant = F.xxhash64(body) if repeats else F.lit(0).cast("long")
    kept = packed(docs, text_col, own.alias("_id"), variant.alias("variant"), body.alias("body"))
    return kept.select(F.col("doc").alias("row"), F.col("_id").alias("doc"), "variant", "body")


def _packed(rows: DataFrame) -> DataFrame:
    """rows with `packed`, the text compressed, in place of `body`: texts take less room in a shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            names = [n for n in batch.schema.names if n != "body"]
            packed = pa.array([compressor.compress(x.as_py().encode()) for x in batch.column("body")], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], packed], names=[*names, "packed"])

    schema = rows.drop("body").withColumn("packed", F.lit(b"")).schema
    return rows.mapInArrow(pack, schema)


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, most: int = MOST_KINDS) -> tuple[DataFrame, DataFrame]:
    """(rows of _keyed, covered stretches (doc, variant, start, end) in bytes; they may pass a text's ends)."""
    rows = _keyed(docs, id_col, text_col)
    before = length - GRAM

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], 2048):
                number, place, gram, around = text_anchors([x.as_py().encode() for x in part.column("body")], length)
                doc, variant = (part.column(c).to_numpy()[number] for c in ("doc", "variant"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(around.view(np.int64)), pa.array(doc), pa.array(variant), pa.array(place.astype(np.int32))],
                    names=["gram", "around", "doc", "variant", "place"],
                )

    found = rows.select("doc", "variant", "body").mapInArrow(find, "gram long, around long, doc long, variant long, place int")
    ordered = found.repartition("gram").sortWithinPartitions("gram", "around", "doc", "variant", "place")
    marks = stored(ordered.mapInArrow(_marked, _MARKS), "substring-marks")
    whole = marks.filter("later").select("doc", "variant", (F.col("place") - before).alias("start"), (F.col("place") + length).alias("end"))
    firsts = marks.filter("not later")
    hot = stored(firsts.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).filter(F.col("kinds") > most).select("gram"), "substring-hot")
    covered = whole.union(_merged(rows, firsts.join(hot, "gram", "left_anti").select(*firsts.columns), length))
    return rows, covered.union(_equal_windows(rows, firsts.join(hot, "gram", "left_semi").select(*firsts.columns), length))


def _merged(rows: DataFrame, firsts: DataFrame, length: int) -> DataFrame:
    """Covered stretches among the surroundings that differ: the merge sort of suffixes."""
    before, parts = length - GRAM, partitions(rows.sparkSession)
    wanted = firsts.groupBy("doc", "variant").agg(F.collect_list(F.struct("gram", "place")).alias("places"))
    held = _packed(rows.select("doc", "variant", "body")).join(wanted, ["doc", "variant"]).select("doc", "variant", "packed", "places")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            suffixes: dict[int, list] = {}
            for doc, variant, packed, places in zip(*(batch.column(c) for c in ("doc", "variant", "packed", "places")), strict=True):
                text, d, v = unpack.decompress(packed.as_py()), doc.as_py(), variant.as_py()
                gram, place = places.values.field(0).to_numpy(), places.values.field(1).to_numpy()
                for part, p in zip((gram.view(np.uint64) % np.uint64(parts)).tolist(), place.tolist(), strict=True):
                    suffixes.setdefault(part, []).append((text[p:p + length], text[max(0, p - before):p][::-1], d, v, p))
            numbers, blobs = [], []
            for part, entries in suffixes.items():
                entries.sort(key=lambda e: e[0])
                common, sizes, rests = front_code([e[0] for e in entries])
                left = b"".join(e[1] for e in entries)
                header = np.array([len(entries), len(rests)], np.int64)
                numbers.append(part)
                blobs.append(pack.compress(b"".join([
                    header.tobytes(), common.tobytes(), sizes.tobytes(), np.array([len(e[1]) for e in entries], np.int32).tobytes(),
                    np.array([e[2:] for e in entries], np.int64).tobytes(), rests, left,
                ])))
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "run"])

    def merged(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        iterators, lefts, owners = [], [], []
        for blob in group.column("run"):
            raw = unpack.decompress(blob.as_py())
            n, size = np.frombuffer(raw, np.int64, 2).tolist()
            common, sizes, left_sizes = np.frombuffer(raw, np.int32, 3 * n, 16).reshape(3, n)
            owners.append(np.frombuffer(raw[16 + 12 * n:16 + 36 * n], np.int64).reshape(n, 3))
            at = 16 + 36 * n
            iterators.append(front_decode(common, sizes, raw[at:at + size]))
            cuts = np.concatenate([[0], np.cumsum(left_sizes)]).tolist()
            left = raw[at + size:]
            lefts.append([left[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        used, common, sizes, before_, owner = [0] * len(iterators), [], [], [], []
        for run, suffix, lcp in merge(iterators):
            i = used[run]
            used[run] += 1
            common.append(lcp)
            sizes.append(len(suffix))
            before_.append(lefts[run][i])
            owner.append(owners[run][i])
        owner = np.array(owner).reshape(-1, 3)
        order = np.empty(len(owner), np.int64)
        order[np.lexsort((owner[:, 2], owner[:, 1], owner[:, 0]))] = np.arange(len(owner))
        covered = covered_offsets(np.array(common), np.array(sizes), before_, order, length)
        # Neighbouring offsets are one stretch.
        edge = np.diff(np.pad(covered.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (row, low), (_, high) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        place = owner[row, 2]
        return pa.table({
            "doc": owner[row, 0], "variant": owner[row, 1],
            "start": pa.array((place - (high - 1)).astype(np.int32)), "end": pa.array((place - low + length).astype(np.int32)),
        })

    exchanged = held.mapInArrow(runs, "part int, run binary")
    return exchanged.groupBy("part").applyInArrow(merged, "doc long, variant long, start int, end int")


def window_hashes(raw: bytes, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the strings of `length` bytes at starts."""
    data, out = np.frombuffer(raw, np.uint8), []
    for values, factor in ((_BYTES, FACTOR), (_BYTES_2, FACTOR_2)):
        inverse = np.full(len(data) + 1, pow(factor, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data] * np.cumprod(inverse)[:-1], dtype=np.uint64)])
        powers = np.full(len(data) + 1, factor, np.uint64)
        powers[0] = 1
        out.append((sums[starts + length] - sums[starts]) * np.cumprod(powers)[starts])
    return out[0], out[1]


def _equal_windows(rows: DataFrame, firsts: DataFrame, length: int) -> DataFrame:
    """Covered stretches around the anchors of grams with very many kinds of surroundings: one row for each string
    with such an anchor, of which all but the earliest of equal ones are covered. A minimum combines before the
    shuffle, so no group is gathered, however many strings are equal or share a gram."""
    wanted = firsts.groupBy("doc", "variant").agg(F.collect_list("place").alias("places"))
    held = _packed(rows.select("doc", "variant", "body")).join(wanted, ["doc", "variant"]).select("doc", "variant", "packed", "places")
    before = np.arange(length - GRAM + 1)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in slices(batches, 64):
            found = [[np.zeros(0, np.int64)] for _ in range(5)]
            for doc, variant, packed, places in zip(*(batch.column(c) for c in ("doc", "variant", "packed", "places")), strict=True):
                text = unpack.decompress(packed.as_py())
                starts = np.unique(places.values.to_numpy().astype(np.int64)[:, None] - before)
                starts = starts[(starts >= 0) & (starts + length <= len(text))]
                own = [np.full(len(starts), x.as_py(), np.int64) for x in (doc, variant)]
                hashes = [h.view(np.int64) for h in window_hashes(text, starts, length)]
                for column, values in zip(found, (*hashes, *own, starts), strict=True):
                    column.append(values)
            columns = [np.concatenate(c) for c in found]
            columns[4] = columns[4].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h1", "h2", "doc", "variant", "start"])

    strings = stored(held.mapInArrow(hashed, "h1 long, h2 long, doc long, variant long, start int"), "substring-strings")
    place = F.struct("doc", "variant", "start")
    first = strings.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = strings.join(first, ["h1", "h2"]).filter(place != F.col("first"))
    return later.select("doc", "variant", "start", (F.col("start") + length).alias("end"))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                     most: int = MOST_KINDS) -> DataFrame:
    """{doc: all columns but the text, n_bytes, kept: binary, spans: array<struct<start,end>>}: the bytes left, and
    the maximal removed runs."""
    rows, covered = repeated(docs, id_col, text_col, length, most)
    spans = covered.groupBy("doc", "variant").agg(F.collect_list(F.struct("start", "end")).alias("covered"))
    met = _packed(rows).join(spans, ["doc", "variant"], "left").select("row", "packed", "covered")
    out = met.select("row").withColumns({
        "n_bytes": F.lit(0).cast("long"), "kept": F.lit(b""),
        "spans": F.array().cast("array<struct<start:int,end:int>>"),
    }).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in slices(batches):
            sizes, kept, spans = [], [], []
            for packed, covered in zip(batch.column("packed"), batch.column("covered"), strict=True):
                text = unpack.decompress(packed.as_py())
                runs = _joined(covered.values, len(text)) if covered.is_valid else []
                at, parts = 0, []
                for start, end in runs:
                    parts.append(text[at:start])
                    at = end
                parts.append(text[at:])
                sizes.append(len(text))
                kept.append(b"".join(parts))
                spans.append([{"start": a, "end": b} for a, b in runs])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)],
                names=["row", "n_bytes", "kept", "spans"],
            )

    return unpacked(met.mapInArrow(cut, out).withColumnRenamed("row", "doc"))


def _joined(covered: pa.StructArray, size: int) -> list[tuple[int, int]]:
    """Maximal runs of stretches, within a text."""
    start = np.maximum(covered.field(0).to_numpy().astype(np.int64), 0)
    end = np.minimum(covered.field(1).to_numpy().astype(np.int64), size)
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    return list(zip(start[first].tolist(), reach[last].tolist(), strict=True))


def query(spark, sf_dir: str) -> DataFrame:
    result = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return result.select(
        "doc.doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
