"""Periodic runs of words: difference-cover extensions on a harmonic grid.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends and
that is at least max(`least`, 2 q) words long. The texts of a batch are one sequence of word numbers
with separators, each found once, between them.

* Only the suffixes at positions whose remainder modulo 13 is in a difference cover are sorted: by
  their first 13 words, then by doubling, where the sample 13 * 2^k words later is a sample too.
* The longest common extension of two positions compares fewer than 13 words to reach a pair of
  samples; a sparse table over the common prefixes of neighbours in the sort gives the rest. The
  same over the reversed sequence extends to the left.
* A run of period p holds two neighbouring points of the grid 0, p, 2p, ... at which equal words
  stand. Such pairs, about n ln n comparisons for all p, are extended both ways and give a run where
  the extensions reach p words. A run comes out for each multiple of its period that it holds twice;
  the smallest is its period.

Texts are packed into batches of about `BATCH` words, so a task holds one batch, or one longer text
(about 150 bytes a word). Everything of a text depends on that text alone.

Defined cases: null and empty texts and those without words have no runs; texts of any length are
taken whole; rows that repeat give equal results; other columns come back unchanged in `doc`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import packed, slices, space_words, table, unpacked

LEAST = 12
BATCH = 1 << 18
PAIRS = 1 << 20  # grid pairs extended at a time
# Every difference modulo 13 is one of two members.
MODULUS, COVER = 13, (0, 1, 3, 9)
RUN = "struct<start:bigint,length:bigint,period:bigint>"
WORD, SPACE = re.compile(r"[^ \t-\r]+"), re.compile(r"[ \t-\r]")


def _shifts() -> np.ndarray:
    """[i, j]: the least d for which i + d and j + d are both in the cover, modulo 13."""
    inside = np.isin(np.arange(2 * MODULUS) % MODULUS, COVER)
    return np.array([
        [next(d for d in range(MODULUS) if inside[i + d] and inside[j + d]) for j in range(MODULUS)]
        for i in range(MODULUS)
    ])


SHIFTS = _shifts()
PLACE = np.array([COVER.index(r) if r in COVER else -1 for r in range(MODULUS)])


def _ranks(order: np.ndarray, differs: np.ndarray) -> np.ndarray:
    """Ranks from an order and where a row differs from the one before it."""
    ranks = np.empty(len(order), dtype=np.int64)
    ranks[order] = np.concatenate([[0], np.cumsum(differs)])
    return ranks


class Extensions:
    """Longest common extensions to the right; the last number stands nowhere else in the sequence."""

    def __init__(self, sequence: np.ndarray):
        n = len(sequence)
        # Past the end all numbers differ from each other and from those inside.
        self.sequence = np.concatenate([sequence, -1 - np.arange(2 * MODULUS)])
        base = np.arange(0, n, MODULUS)[:, None] + np.array(COVER)[None, :]
        positions = base.ravel()
        positions = positions[positions < n]
        levels = self._sorted(positions)
        self.rank = levels[-1]
        self.rows = self._table(self._neighbours(positions, levels))

    def _sorted(self, positions: np.ndarray) -> list[np.ndarray]:
        """Ranks of the samples by their first 13, 26, 52, ... words, until all differ."""
        m = len(positions)
        low = int(self.sequence.min())
        bits = int(self.sequence.max() - low + 1).bit_length()
        each = 63 // bits
        keys = []
        for start in range(0, MODULUS, each):
            key = np.zeros(m, dtype=np.int64)
            for d in range(start, min(start + each, MODULUS)):
                key = (key << bits) | (self.sequence[positions + d] - low)
            keys.append(key)
        order = np.lexsort(keys[::-1])
        differs = np.zeros(max(m - 1, 0), dtype=bool)
        for key in keys:
            differs |= np.diff(key[order]) != 0
        levels = [_ranks(order, differs)]
        ahead = len(COVER)
        while levels[-1].max() < m - 1:
            last = levels[-1]
            following = np.full(m, -1, dtype=np.int64)
            following[:m - ahead] = last[ahead:]
            key = last * (m + 1) + following + 1
            order = np.argsort(key)
            levels.append(_ranks(order, np.diff(key[order]) != 0))
            ahead *= 2
        return levels

    def _neighbours(self, positions: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefix lengths of neighbours in the sort, from the ranks of all levels."""
        m = len(positions)
        order = np.empty(m, dtype=np.int64)
        order[levels[-1]] = np.arange(m)
        a, b = order[:-1].copy(), order[1:].copy()
        for level in range(len(levels) - 1, -1, -1):
            # Equal blocks lack the last number, so the sample behind them exists.
            same = levels[level][a] == levels[level][b]
            step = len(COVER) << level
            a[same] += step
            b[same] += step
        x, y = positions[a], positions[b]
        common = x - positions[order[:-1]]
        live = np.arange(m - 1)
        for d in range(MODULUS):
            live = live[self.sequence[x[live] + d] == self.sequence[y[live] + d]]
            common[live] += 1
        return common

    def _table(self, common: np.ndarray) -> list[np.ndarray]:
        """Minima of 1, 2, 4, ... neighbouring values."""
        rows, width = [common], 1
        while 2 * width <= len(common):
            last = rows[-1]
            rows.append(np.minimum(last[:-width], last[width:]))
            width *= 2
        self.starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        return np.concatenate(rows)

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Number of words equal from x and y on, for positions x != y."""
        out = np.zeros(len(x), dtype=np.int64)
        shift = SHIFTS[x % MODULUS, y % MODULUS]
        live = np.arange(len(x))
        for d in range(MODULUS):
            more = shift[live] > d
            at = live[more]
            same = self.sequence[x[at] + d] == self.sequence[y[at] + d]
            out[at[same]] += 1
            live = np.concatenate([live[~more], at[same]])
            if d and not more.any():
                break
        # What is left agrees up to its samples.
        a, b = x[live] + shift[live], y[live] + shift[live]
        a = self.rank[a // MODULUS * len(COVER) + PLACE[a % MODULUS]]
        b = self.rank[b // MODULUS * len(COVER) + PLACE[b % MODULUS]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        start = self.starts[level]
        out[live] += np.minimum(self.rows[start + low], self.rows[start + high - (1 << level)])
        return out


def grid_pairs(sequence: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, p) of equal words at x and x + p, for the multiples x of each p up to half the longest text."""
    xs, ps, held = [], [], 0
    for p in range(1, longest // 2 + 1):
        x = np.flatnonzero(sequence[:-p:p] == sequence[p::p]) * p
        if len(x):
            xs.append(x)
            ps.append(np.full(len(x), p))
            held += len(x)
        if held >= PAIRS:
            yield np.concatenate(xs), np.concatenate(ps)
            xs, ps, held = [], [], 0
    if held:
        yield np.concatenate(xs), np.concatenate(ps)


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Rows (start, end, period): of each stretch the one of the smallest period."""
    order = np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))
    runs = runs[order]
    first = np.ones(len(runs), dtype=bool)
    first[1:] = (np.diff(runs[:, :2], axis=0) != 0).any(axis=1)
    return runs[first]


def find_runs(sequence: np.ndarray, longest: int, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of all runs. Numbers are 0 or more; the first and the last stand
    nowhere else, and no run is longer than `longest`."""
    n = len(sequence)
    none = np.zeros((0, 3), dtype=np.int64)
    right = left = None
    found = none
    for x, p in grid_pairs(sequence, longest):
        if right is None:
            right, left = Extensions(sequence), Extensions(sequence[::-1])
        for i in range(0, len(x), PAIRS):
            a, q = x[i:i + PAIRS], p[i:i + PAIRS]
            forward = right.of(a, a + q)
            back = left.of(n - a, n - a - q)
            fits = (forward + back >= q) & (forward + back + q >= least)
            runs = np.column_stack([a - back, a + q + forward, q])[fits]
            found = _smallest(np.concatenate([found, runs]))
    return found


def word_numbers(text: str, numbers: dict[str, int]) -> np.ndarray:
    """Numbers of the words of a text, in pieces, so that equal words are held once."""
    out, at = [], 0
    while at < len(text):
        cut = SPACE.search(text, min(at + (1 << 20), len(text)))
        end = cut.start() if cut else len(text)
        out.append(np.array([numbers.setdefault(w, len(numbers)) for w in WORD.findall(text, at, end)], dtype=np.int64))
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def runs_of(texts: list[str], least: int = LEAST) -> list[tuple[int, np.ndarray, str]]:
    """(number of words, rows (start, length, period) by start and period, collapsed text) of each text."""
    numbers: dict[str, int] = {}
    words = [word_numbers(t, numbers) for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    known = list(numbers)
    starts = np.cumsum(sizes + 1) - sizes  # each text follows its separator
    sequence = np.empty(int(sizes.sum()) + len(texts) + 1, dtype=np.int64)
    ends = np.append(starts - 1, len(sequence) - 1)
    sequence[ends] = len(known) + np.arange(len(ends))
    for start, w in zip(starts, words, strict=True):
        sequence[start:start + len(w)] = w
    runs = find_runs(sequence, int(sizes.max(initial=0)), least)
    repeated = np.zeros(len(sequence) + 1, dtype=np.int64)
    np.add.at(repeated, runs[:, 0] + runs[:, 2], 1)
    np.add.at(repeated, runs[:, 1], -1)
    repeated = np.cumsum(repeated) > 0
    owner = np.searchsorted(starts, runs[:, 0], side="right") - 1
    order = np.lexsort((runs[:, 2], runs[:, 0], owner))
    runs, owner = runs[order], owner[order]
    limits = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i, (start, w) in enumerate(zip(starts.tolist(), words, strict=True)):
        mine = runs[limits[i]:limits[i + 1]]
        rows = np.column_stack([mine[:, 0] - start, mine[:, 1] - mine[:, 0], mine[:, 2]])
        kept = w[~repeated[start:start + len(w)]] if len(mine) else w
        out.append((len(w), rows, " ".join(map(known.__getitem__, kept.tolist()))))
    return out


def _packs(texts: list[str]) -> Iterator[list[int]]:
    """Indices of texts in packs of alike length; characters / 4 stand for words."""
    pack, held = [], 0
    for i in sorted(range(len(texts)), key=lambda i: len(texts[i])):
        size = len(texts[i]) // 4 + 1
        if pack and held + size > BATCH:
            yield pack
            pack, held = [], 0
        pack.append(i)
        held += size
    if pack:
        yield pack


def detect_runs(docs: DataFrame, text_col: str | Column = "text", least: int = LEAST) -> DataFrame:
    """{doc: all columns (but a text column given by name), n_words, runs: array of (start, length,
    period) by start and period, collapsed: words that no run holds after its first period}."""
    body = F.col(f"`{text_col}`") if isinstance(text_col, str) else text_col
    rows = packed(docs, text_col if isinstance(text_col, str) else None, F.coalesce(body, F.lit("")).alias("body"))
    kind = rows.schema["doc"].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("body").to_pylist()
            results: list = [None] * len(texts)
            for pack in _packs(texts):
                for i, result in zip(pack, runs_of([texts[i] for i in pack], least), strict=True):
                    results[i] = result
            tables = [r[1] for r in results]
            flat = np.concatenate(tables) if tables else np.zeros((0, 3), dtype=np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in tables])]).astype(np.int32)
            struct = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array([r[0] for r in results], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), struct), pa.array([r[2] for r in results], pa.string())],
                names=["doc", "n_words", "runs", "collapsed"],
            )

    return unpacked(rows.mapInArrow(found, f"doc {kind}, n_words bigint, runs array<{RUN}>, collapsed string"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs with `edited`: the text, for a tenth of the ids with its end replaced by a repeated stretch."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    counted = docs.withColumns({"_words": space_words(F.col("text")), "_g": F.floor(h / 10), "_h": h})
    n = F.size("_words")
    placed = counted.withColumns({"_n": n, "_a": F.when(n > 0, F.col("_g") % n).cast("int")})
    p = (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int")
    placed = placed.withColumn("_p", p)
    times = F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice("_words", F.col("_a") + 1, F.col("_p")), times))
    words = F.concat(F.slice("_words", F.lit(1), F.col("_a")), F.slice(cycle, F.lit(1), F.col("_n") - F.col("_a")))
    edited = F.when((F.col("_h") % 10 == 0) & (F.col("_n") > 0), F.array_join(words, " ")).otherwise(F.col("text"))
    return placed.select(*docs.columns, edited.alias("edited"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = detect_runs(docs.select("doc_id", "edited"), "edited")
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r.length).alias("l"), r.start.alias("s"), r.period.alias("p")))), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return found.withColumn("best", best).select(
        "doc.doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"), F.floor(-1000 * F.col("best.l") / F.col("best.p")).alias("exponent_milli"),
        sha(F.array_join(lines, "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"), "n_words",
    )
