"""Toxicity: maximum-scoring passages over token log-odds, calibrated by extreme values.

Learning (labelled rows only). Tokens count under their word and its beginnings (4 to 6 letters,
which join inflected forms). Counts go to a sketch of DEPTH rows of WIDTH counters; of a feature's
counters the smallest is taken, so what goes to the driver and to tasks has a fixed size while the
counts cover all text. A word counts once in each document. A feature's log-odds between toxic and
clean text have a Dirichlet prior that follows its share in both. Features whose likelihood ratio
could be chance among as many as there are, or whose log-odds are below `odds_least`, tell nothing.
A token scores its strongest feature's log-odds; all others score the (negative) log-odds of such
tokens.

Scoring. The tokens of a text are scanned once; Ruzzo and Tompa's algorithm gives all maximal
scoring passages in time linear in the tokens (stretches of equal negative scores are one step).
By Karlin and Altschul a passage of score S in a text of n tokens is expected K n exp(-lambda S)
times in clean text, where lambda solves sum p exp(lambda s) = 1 over clean text's token scores.
Passages expected less than `expected_most` times are significant. A text's evidence is the sum of
-ln(expectation) over them, and a logistic curve fitted to the learnt rows makes it a probability.

Defined cases: null and empty texts have no tokens and get the curve's value at no evidence; a
label other than 0 or 1 counts as none; without labels of both kinds every score is the smoothed
rate; repeated rows each count; several labels of one id are learnt as their largest; other
columns come back unchanged in `doc`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliograph.llm.common import bounded_labels, packed, slices, table, unpacked

DEPTH, WIDTH = 2, 1 << 20
PREFIXES = (4, 5, 6)
MOST_LABELS = 200_000  # labelled rows that are learnt from, at most
SEED = 42  # of Spark's xxhash64
WORD = re.compile(r"[^\W_]+")  # runs of letters and digits
PASSAGE = "array<struct<first:int,last:int,score:double,expected:double>>"


def features(word: str) -> list[str]:
    return [word, *[f"{word[:k]}~" for k in PREFIXES if len(word) >= k]]


def _feature_columns(word: Column) -> Column:
    starts = [F.when(F.char_length(word) >= k, F.concat(F.left(word, F.lit(k)), F.lit("~"))) for k in PREFIXES]
    return F.filter(F.array(word, *starts), lambda f: f.isNotNull())


def sketch(words: DataFrame) -> np.ndarray:
    """Counters (DEPTH, WIDTH, 2: clean and toxic) of rows (word, clean, toxic)."""
    hashed = words.select(F.explode(_feature_columns(F.col("word"))).alias("f"), "clean", "toxic").withColumn("h", F.xxhash64("f"))
    cells = [
        F.struct(F.lit(d).alias("row"), F.shiftrightunsigned("h", 20 * d).bitwiseAND(WIDTH - 1).cast("int").alias("cell"))
        for d in range(DEPTH)
    ]
    counted = hashed.select(F.explode(F.array(*cells)).alias("c"), "clean", "toxic").groupBy("c.row", "c.cell").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    ).toArrow()
    counts = np.zeros((DEPTH, WIDTH, 2), dtype=np.int64)
    at = (counted.column("row").to_numpy(), counted.column("cell").to_numpy())
    counts[(*at, 0)], counts[(*at, 1)] = counted.column("clean").to_numpy(), counted.column("toxic").to_numpy()
    return counts


@dataclass
class Model:
    counts: np.ndarray
    clean: float
    toxic: float
    prior: float
    odds_least: float
    expected_most: float
    ratio_least: float = 0.0
    base: float = -0.01
    lam: float = 1.0
    k: float = 0.1
    curve: tuple[float, float] = (0.0, 0.0)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-odds of words; NaN for those that tell nothing."""
        import xxhash

        owners, hashes = [], []
        for i, word in enumerate(words):
            for f in features(word):
                owners.append(i)
                hashes.append(xxhash.xxh64_intdigest(f, SEED))
        h = np.array(hashes, dtype=np.uint64)
        cells = [(h >> np.uint64(20 * d)) & np.uint64(WIDTH - 1) for d in range(DEPTH)]
        seen = np.min([self.counts[d][c.astype(np.int64)] for d, c in enumerate(cells)], axis=0)
        clean, toxic = seen[:, 0].astype(float), seen[:, 1].astype(float)
        share = (clean + toxic + 0.01) / (self.clean + self.toxic)
        a, b = toxic + self.prior * share, clean + self.prior * share
        odds = np.log(a / (self.toxic + self.prior - a)) - np.log(b / (self.clean + self.prior - b))
        both = (clean + toxic) / (self.clean + self.toxic)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = 2 * (np.nan_to_num(toxic * np.log(toxic / (both * self.toxic))) + np.nan_to_num(clean * np.log(clean / (both * self.clean))))
        odds[(ratio < self.ratio_least) | (odds < self.odds_least)] = -np.inf
        best = np.full(len(words), -np.inf)
        np.maximum.at(best, np.array(owners, dtype=np.int64), odds)
        best[~np.isfinite(best)] = np.nan
        return best

    def passages(self, n: int, at: np.ndarray, scores: np.ndarray) -> list[tuple[int, int, float, float]]:
        """Significant passages (first, last token, score, expected number) of a text of n tokens, of which
        those at `at` have positive scores."""
        found = []
        for first, last, score in maximal_segments(at, scores, self.base):
            expected = self.k * n * math.exp(-self.lam * score)
            if expected < self.expected_most:
                found.append((first, last, score, expected))
        return found


def maximal_segments(at, scores, base: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of tokens that score `base` (negative) but at `at`: linear in len(at).

    A candidate keeps the sums before and after it. A new one is joined with the nearest earlier
    candidate whose sum before is smaller, unless that one's sum after is as large as its own; the
    links to such candidates replace the search through all earlier ones."""
    stack: list[list] = []  # first, last, sum before, sum after, link to the earlier candidate with a smaller sum before
    total, done = 0.0, 0
    for place, score in zip(at, scores, strict=True):
        total += base * (place - done)
        before, done = total, place + 1
        total += score
        new = [int(place), int(place), before, total, -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                new[4] = j
                stack.append(new)
                break
            new[0], new[2] = stack[j][0], stack[j][2]
            del stack[j:]
    return [(first, last, after - before) for first, last, before, after, _ in stack]


class Scorer:
    """Scores of tokens by word, remembered within a task up to a fixed number of words."""

    def __init__(self, model: Model, most: int = 400_000):
        self.model, self.known, self.most = model, {}, most

    def text(self, text: str) -> tuple[int, list[int], list[float]]:
        words = WORD.findall(text.lower())
        missing = [w for w in set(words) if w not in self.known]
        if missing:
            if len(self.known) > self.most:
                self.known.clear()
                missing = list(set(words))
            self.known.update(zip(missing, self.model.word_scores(missing).tolist(), strict=True))
        known = self.known
        scores = [known[w] for w in words]
        at = [i for i, s in enumerate(scores) if s == s]
        return len(words), at, [scores[i] for i in at]


def learn(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", prior: float = 1000.0,
          odds_least: float = 2.0, expected_most: float = 0.05) -> Model:
    """The model of rows (text, label 0 or 1)."""
    rows = labelled.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("body"), F.col(f"`{label_col}`").cast("int").alias("label"))
    parts = F.split(F.lower("body"), r"[^\p{L}\p{N}]+")
    words = rows.select(F.explode(F.array_distinct(parts)).alias("word"), "label").filter("word <> ''").groupBy("word").agg(
        F.sum(1 - F.col("label")).alias("clean"), F.sum("label").alias("toxic")
    )
    counts = sketch(words)
    distinct = F.size(F.array_distinct(parts))
    sums = rows.agg(
        F.sum(F.when(F.col("label") == 0, distinct)).alias("clean"), F.sum(F.when(F.col("label") == 1, distinct)).alias("toxic"),
        F.count(F.when(F.col("label") == 0, 1)).alias("clean_rows"), F.count(F.when(F.col("label") == 1, 1)).alias("toxic_rows"),
    ).first()
    model = Model(counts, float(sums.clean or 0) + 1, float(sums.toxic or 0) + 1, prior, odds_least, expected_most)
    model.ratio_least = 2 * math.log(max(int(np.count_nonzero(counts[0].sum(axis=1))), 2))
    rate = (sums.toxic_rows + 0.5) / (sums.clean_rows + sums.toxic_rows + 1)
    model.curve = (math.log(rate / (1 - rate)), 0.0)
    if not sums.clean_rows or not sums.toxic_rows:
        model.counts = np.zeros_like(counts)
        return model
    _calibrate_tokens(rows, model)
    _calibrate_curve(rows, model)
    return model


def _score_counts(rows: DataFrame, model: Model) -> list:
    """Tokens by label and score (in quarters; -1: no score), at most a few hundred rows."""
    handle = rows.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, found = Scorer(handle.value), {}
        for batch in batches:
            for text, label in zip(batch.column("body").to_pylist(), batch.column("label").to_pylist(), strict=True):
                n, at, scores = scorer.text(text)
                found[label, -1] = found.get((label, -1), 0) + n - len(at)
                for s in scores:
                    key = (label, min(int(s * 4), 100))
                    found[key] = found.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in found], pa.int32()), pa.array([k[1] for k in found], pa.int32()), pa.array(list(found.values()), pa.int64())],
            names=["label", "quarter", "n"],
        )

    return rows.mapInArrow(count, "label int, quarter int, n long").groupBy("label", "quarter").agg(F.sum("n").alias("n")).collect()


def _calibrate_tokens(rows: DataFrame, model: Model) -> None:
    """base, lambda and K from how tokens score in clean and toxic text."""
    tokens = {(r.label, r.quarter): r.n for r in _score_counts(rows, model)}
    n = {label: sum(v for (x, _), v in tokens.items() if x == label) + 1 for label in (0, 1)}
    plain = {label: (tokens.get((label, -1), 0) + 0.5) / n[label] for label in (0, 1)}
    model.base = min(math.log(plain[1] / plain[0]), -1e-3)
    shares = [(model.base, plain[0])] + [
        ((q + 0.5) / 4, (tokens.get((0, q), 0) + 0.5) / n[0]) for q in sorted({q for _, q in tokens if q >= 0})
    ]
    total = sum(p for _, p in shares)
    shares = [(s, p / total) for s, p in shares]
    if sum(s * p for s, p in shares) >= 0:  # clean text must drift down
        model.base = -2 * sum(s * p for s, p in shares[1:]) / shares[0][1]
        shares[0] = (model.base, shares[0][1])
    low, high = 0.0, 1.0
    excess = lambda x: sum(p * math.exp(min(x * s, 500)) for s, p in shares) - 1
    while len(shares) > 1 and excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    model.lam = max(high, 1e-3)
    # Expected ladder height gives the scale of K for walks of small negative steps.
    drift = -sum(s * p for s, p in shares)
    model.k = max(min(model.lam * drift, 1.0), 1e-6)


def evidence(passages) -> float:
    return sum(-math.log(max(p[3], 1e-300)) for p in passages)


def _scored(model_handle, body: str, keep: list[str], out: T.StructType):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_handle.value
        scorer = Scorer(model)
        for batch in slices(batches):
            passages, sums = [], []
            for text in batch.column(body).to_pylist():
                found = model.passages(*scorer.text(text))
                passages.append([{"first": a, "last": b, "score": s, "expected": e} for a, b, s, e in found])
                sums.append(evidence(found))
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(passages, kind), pa.array(sums, pa.float64())], names=[*keep, "passages", "evidence"]
            )

    return score


def _calibrate_curve(rows: DataFrame, model: Model, bins: int = 400) -> None:
    """Logistic curve over evidence (in steps, at most `bins`), by Newton's method on counts."""
    handle = rows.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([T.StructField("label", T.IntegerType()), *_passage_fields()])
    scored = rows.mapInArrow(_scored(handle, "body", ["label"], out), out)
    step = F.least(F.floor(F.log1p("evidence") * 40), F.lit(bins)).cast("int")
    counts = scored.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")).collect()
    x = np.array([r.step / 40 for r in counts])
    n, y = np.array([r.n for r in counts], float), np.array([r.toxic for r in counts], float)
    w = np.array(model.curve)
    design = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        ridge = np.array([1e-3, 1e-1])
        gradient = design.T @ (y - n * p) - ridge * w
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        move = np.linalg.solve(hessian, gradient)
        w = w + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    model.curve = (float(w[0]), max(float(w[1]), 0.0))


def _passage_fields() -> list[T.StructField]:
    return [T.StructField("passages", T._parse_datatype_string(PASSAGE)), T.StructField("evidence", T.DoubleType())]


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """{doc: all columns but the text, passages, evidence, score, predicted}; passages count tokens from 0."""
    rows = packed(docs, text_col, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("body"))
    handle = docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([rows.schema["doc"], *_passage_fields()])
    scored = unpacked(rows.mapInArrow(_scored(handle, "body", ["doc"], out), out))
    probability = 1 / (1 + F.exp(-(F.lit(model.curve[0]) + F.lit(model.curve[1]) * F.log1p("evidence"))))
    return scored.withColumn("score", probability).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    used = bounded_labels(labels.filter(~held_out()), "doc_id", "toxic", MOST_LABELS, F.max)
    model = learn(docs.join(used, docs["doc_id"] == used["_id"]).select("text", F.col("_label").alias("toxic")))
    result = score(docs.select("doc_id", "text"), model).withColumn("doc_id", F.col("doc.doc_id"))
    return result.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted", "evidence", F.size("passages").alias("n_passages")
    )
