"""Token counts of the parts of documents, from one encoding of each whole document.

A text is encoded once as a whole. Its tokens are spans of characters (a token that holds some
bytes of a character spans that character), and so are its parts, here its lines or any given
spans. Both lists of spans are sorted, so their interval join is two binary searches for each
token. A token that crosses a boundary is given to parts by a rule:

* start: to the part that holds its first character;
* end: to the part that holds its last character;
* share: to every part it touches, in proportion to the characters there.

With parts that cover the text, the counts of a document add up to its number of tokens under
every rule; tokens outside all parts are counted under part -1.

Defined cases: a null or empty text is one empty part with no tokens; rows that repeat come back
as often; an empty table gives an empty table; other columns come back unchanged in `doc`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliograph.llm import bpe
from foliograph.llm.common import packed, slices, table, unpacked

RULES = ("start", "end", "share")


def token_spans(text: str, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and the one after the last of each token."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
    after = np.cumsum(lengths[ids])
    first = after - lengths[ids]
    return character[first], character[after - 1] + 1


def line_spans(text: str) -> np.ndarray:
    """Start and end of each line; its \\n belongs to it."""
    raw = text.split("\n")
    ends = np.cumsum([len(x) + 1 for x in raw])
    ends[-1] -= 1
    return np.stack([np.concatenate([[0], ends[:-1]]), ends], axis=1)


def attribute(first: np.ndarray, after: np.ndarray, parts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """(tokens of each part, crossing tokens that touch it, tokens outside all parts).

    parts: rows of (start, end), sorted and not overlapping; empty parts get nothing."""
    n = len(parts)
    counts, crossing = np.zeros(n), np.zeros(n, dtype=np.int64)
    if not len(first):
        return counts, crossing, 0.0
    full = np.flatnonzero(parts[:, 1] > parts[:, 0])
    if not len(full):
        return counts, crossing, float(len(first))
    starts, ends = parts[full, 0], parts[full, 1]
    low = np.searchsorted(ends, first, side="right")  # the first part that ends after the token's start
    high = np.searchsorted(starts, after, side="left") - 1  # the last part that starts before its end
    inside = (low < len(full)) & (high >= low)
    whole = inside & (low == high)
    whole[whole] = (starts[low[whole]] <= first[whole]) & (ends[low[whole]] >= after[whole])
    np.add.at(counts, full[low[whole]], 1)
    outside = float(np.sum(~inside))
    for t in np.flatnonzero(inside & ~whole):  # few: at most about one for each boundary
        touched = range(low[t], high[t] + 1)
        crossing[full[list(touched)]] += 1
        if rule == "share":
            width = after[t] - first[t]
            given = 0.0
            for p in touched:
                share = (min(after[t], ends[p]) - max(first[t], starts[p])) / width
                counts[full[p]] += share
                given += share
            outside += 1.0 - given
        else:
            p, place = (low[t], first[t]) if rule == "start" else (high[t], after[t] - 1)
            if starts[p] <= place < ends[p]:
                counts[full[p]] += 1
            else:
                outside += 1
    return counts, crossing, outside


def count_tokens(
    docs: DataFrame, text_col: str = "text", spans_col: str | None = None, rule: str = "start",
    ranks_path: str | None = None,
) -> DataFrame:
    """One row per document and part: {doc: all columns but the text, part, part_start, part_end,
    n_tokens: double, n_crossing}. spans_col: an array of struct(start, end) in characters, sorted and
    not overlapping; None takes the lines of the text."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ranks_path = ranks_path or bpe.default_ranks()
    spans = F.col(f"`{spans_col}`") if spans_col else F.lit(None)
    rows = packed(
        docs, (text_col, spans_col), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("body"),
        spans.cast("array<struct<start:int,end:int>>").alias("spans"),
    )
    part = T.ArrayType(T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("part_start", T.IntegerType()),
        T.StructField("part_end", T.IntegerType()), T.StructField("n_tokens", T.DoubleType()),
        T.StructField("n_crossing", T.IntegerType()),
    ]))
    out = T.StructType([T.StructField("doc", rows.schema["doc"].dataType), T.StructField("parts", part)])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = bpe.codec(ranks_path)
        for batch in slices(batches):
            columns: list[list[np.ndarray]] = [[], [], [], [], []]
            sizes = [0]
            for text, given in zip(batch.column("body").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                ids = c.encode(text, 32768)
                first, after = token_spans(text, ids, c.lengths)
                parts = line_spans(text) if given is None else np.array(
                    [(s["start"], s["end"]) for s in given if s and s["start"] is not None and s["end"] is not None], dtype=np.int64
                ).reshape(-1, 2)
                counts, crossing, outside = attribute(first, after, parts, rule)
                number = np.arange(len(parts))
                if outside > 1e-9:
                    number, parts = np.append(number, -1), np.append(parts, [[0, len(text)]], axis=0)
                    counts, crossing = np.append(counts, outside), np.append(crossing, 0)
                for column, values in zip(columns, (number, parts[:, 0], parts[:, 1], counts, crossing), strict=True):
                    column.append(values)
                sizes.append(sizes[-1] + len(number))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32())
            arrays = [pa.array(np.concatenate(x), kind) for x, kind in zip(columns, kinds, strict=True)]
            struct = pa.StructArray.from_arrays(arrays, names=[f.name for f in part.elementType.fields])
            parts_column = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), struct)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), parts_column], names=["doc", "parts"])

    return unpacked(rows.mapInArrow(counted, out)).select("doc", F.inline("parts"))


def query(spark, sf_dir: str) -> DataFrame:
    """Tokens of every line of documents; a token belongs to the line of its first character."""
    counts = count_tokens(table(spark, sf_dir, "documents"))
    return counts.select(
        "doc.doc_id", F.col("part").alias("line"), "part_start", "part_end",
        F.col("n_tokens").cast("long").alias("n_tokens"), "n_crossing",
    )
