"""Hard-negative mining: exact integer inner products by Strassen's recursion, then mergeable heaps.

Vectors become integers (floor(scale * x)). Rows are dealt into strips of about `strip` rows, each
of the labels of one bucket; anchors are dealt into strips of their own, and a pair of strips is one
group of a cogrouped map. In a group, tiles of anchors times candidates are multiplied in int64 by
Strassen's seven products of halves (odd sides get a zero row or column; small sides are multiplied
directly). Additions and products wrap modulo 2^64, so a score is exact wherever it fits a long.

1. Positives: anchors meet the strips of their own label's bucket. The best `positives` of each
   (anchor, strip) stay in a heap, which tiles update; heaps of strips merge by rank.
2. Windows: anchors, with their at most `positives` positives, meet all strips. Each (anchor,
   positive) has a heap of the best `negatives` scores inside its window; they merge likewise.

Every anchor is compared with every row, in blocks. What a group holds is bounded by the strips;
candidates are sent once for every strip of anchors, anchors once for every strip of candidates.

Defined cases: a row without id, label or vector, or with a null or non-finite component, takes no
part; components are clipped to the range of long; vectors of unequal length are padded with
zeros (an empty one scores 0 with all). Rows that repeat, also under one id, are rows of their own:
each is anchor and candidate, and only the row itself is not its own positive. Equal scores come by
smaller id. An anchor without positives, or a window without rows, gives no rows; so does an empty
table. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.llm.common import stored, table

LEAF = 8  # sides up to this are multiplied directly
BUCKETS = 256  # of labels
TILE_ANCHORS, TILE_ROWS = 512, 2048
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Product of two int64 matrices, modulo 2^64."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    m6 = strassen(a21 - a11, b11 + b12, leaf)
    m7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * l), dtype=np.int64)
    out[:i, :l] = m1 + m4 - m5 + m7
    out[:i, l:] = m3 + m5
    out[i:, :l] = m2 + m4
    out[i:, l:] = m1 - m2 + m3 + m6
    return out[:m, :n]


class Heaps:
    """The best `size` (score, id) of each of `n` keys; larger scores first, then smaller ids."""

    def __init__(self, n: int, size: int):
        self.n, self.size = n, size
        self.key, self.score, self.id = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.least = np.full(n, LEAST, dtype=np.int64)  # scores below this can not enter

    def push(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(key):
            return
        key, score, ids = np.append(self.key, key), np.append(self.score, score), np.append(self.id, ids)
        order = np.lexsort((ids, ~score, key))
        key = key[order]
        starts = np.searchsorted(key, np.arange(self.n))
        rank = np.arange(len(key)) - starts[key]
        kept = order[rank < self.size]
        self.score, self.id = score[kept], ids[kept]
        self.key = key[rank < self.size]
        last = np.flatnonzero(rank == self.size - 1)
        self.least[key[last]] = score[order[last]]

    def offer(self, keys: np.ndarray, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
        """A tile: scores[i, j] of key keys[i] and candidate ids[j], where fits."""
        fits = fits & (scores >= self.least[keys][:, None])
        if scores.shape[1] > self.size and np.count_nonzero(fits) > 4 * self.size * len(keys):
            ranked = np.where(fits, scores, LEAST)
            fits &= scores >= np.partition(ranked, -self.size, axis=1)[:, -self.size][:, None]
        row, column = np.nonzero(fits)
        self.push(keys[row], scores[row, column], ids[column])


def _long(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64, copy=False)


def matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows, padded with zeros up to width."""
    flat = vectors.combine_chunks()
    offsets = flat.offsets.to_numpy()
    values = flat.values.to_numpy()[offsets[0]:offsets[-1]]
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = values
    return out


def _width(vectors: pa.ChunkedArray) -> int:
    import pyarrow.compute as pc

    return pc.max(pc.list_value_length(vectors)).as_py() or 0


def _tiles(anchors: pa.Table, rows: pa.Table):
    """(slice of anchors, slice of rows, scores) of all tiles."""
    width = max(_width(anchors.column("v")), _width(rows.column("v")), 1)
    left, right = matrix(anchors.column("v"), width), matrix(rows.column("v"), width)
    for i in range(0, len(left), TILE_ANCHORS):
        for j in range(0, len(right), TILE_ROWS):
            mine, theirs = slice(i, i + TILE_ANCHORS), slice(j, j + TILE_ROWS)
            yield mine, theirs, strassen(left[mine], np.ascontiguousarray(right[theirs].T))


def _positives_of(size: int):
    def best(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return pa.table({"uid": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "id": pa.array([], pa.int64())})
        uid, label = _long(anchors.column("uid")), _long(anchors.column("label"))
        ids, uids, labels = (_long(rows.column(c)) for c in ("id", "uid", "label"))
        heaps = Heaps(len(uid), size)
        for mine, theirs, scores in _tiles(anchors, rows):
            fits = (label[mine, None] == labels[None, theirs]) & (uid[mine, None] != uids[None, theirs])
            heaps.offer(np.arange(len(uid))[mine], scores, fits, ids[theirs])
        return pa.table({"uid": uid[heaps.key], "score": heaps.score, "id": heaps.id})

    return best


def windows(scores: list[int], low: int, high: int) -> tuple[list[int], list[int]]:
    """Least and largest s with low * score <= 100 * s <= high * score, for each score."""
    clip = lambda x: max(LEAST, min(MOST, x))
    return [clip(-(-low * s // 100)) for s in scores], [clip(high * s // 100) for s in scores]


def _negatives_of(size: int, low: int, high: int):
    names = ("uid", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")

    def best(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        uid, label, anchor_id = (_long(anchors.column(c)) for c in ("uid", "label", "id"))
        ids, labels = _long(rows.column("id")), _long(rows.column("label"))
        given = anchors.column("positives").to_pylist()
        most = max(map(len, given))
        shape = (len(uid), most)
        least, largest = np.full(shape, MOST, dtype=np.int64), np.full(shape, LEAST, dtype=np.int64)
        positive = np.zeros((2, *shape), dtype=np.int64)
        for a, found in enumerate(given):
            scores = [p["score"] for p in found]
            least[a, :len(found)], largest[a, :len(found)] = windows(scores, low, high)
            positive[:, a, :len(found)] = [p["id"] for p in found], scores
        heaps = Heaps(len(uid) * most, size)
        number = np.arange(len(uid))
        for mine, theirs, scores in _tiles(anchors, rows):
            differs = label[mine, None] != labels[None, theirs]
            if differs.any():
                for p in range(most):
                    fits = differs & (scores >= least[mine, p][:, None]) & (scores <= largest[mine, p][:, None])
                    heaps.offer(number[mine] * most + p, scores, fits, ids[theirs])
        a, p = np.divmod(heaps.key, most)
        columns = (uid[a], p, anchor_id[a], positive[0, a, p], positive[1, a, p], heaps.id, heaps.score)
        return pa.table(dict(zip(names, columns, strict=True)))

    return best


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def prepared(
    rows: DataFrame, id_col: str, vector_col: str, label: Column, anchor: Column, scale: int
) -> DataFrame:
    """Rows that take part: uid, id, label, v (integers), anchor."""
    named = rows.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"), label.cast("bigint").alias("label"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )
    whole = named.filter("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").filter(F.forall("x", _finite))
    integers = F.transform("x", lambda x: F.floor(x * float(scale)).cast("bigint"))
    return whole.select(F.monotonically_increasing_id().alias("uid"), "id", "label", integers.alias("v"), "anchor")


def mine(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None,
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, strip: int = 65536,
) -> DataFrame:
    """Per anchor (rows for which the condition holds) and positive the best rows of other labels whose
    score is low to high percent of the positive's: anchor_id, positive_id, positive_rank, rank,
    negative_id, positive_score, negative_score. label: an integer column, `label` if not given."""
    label = F.col("label") if label is None else label
    # Row numbers must not change between the passes: they are written once.
    kept = stored(prepared(rows, id_col, vector_col, label, anchor, scale), "negatives-rows")
    bucket = F.pmod(F.hash("label"), F.lit(BUCKETS))
    sizes = {r.bucket: (r.n, r.anchors) for r in kept.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("anchors")).collect()}
    spans = [-(-sizes.get(b, (0, 0))[0] // strip) for b in range(BUCKETS)]
    first = np.concatenate([[0], np.cumsum(spans)]).tolist()
    anchor_strips = max(1, -(-sum(a for _, a in sizes.values()) // strip))
    span = F.get(F.array(*[F.lit(int(s)) for s in spans]), bucket)
    start = F.get(F.array(*[F.lit(int(s)) for s in first]), bucket)

    candidates = kept.select("uid", "id", "label", "v", (start + F.pmod(F.xxhash64("uid"), span)).cast("bigint").alias("strip"))
    candidates = candidates.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(anchor_strips - 1))))
    anchors = kept.filter("anchor").select(
        *[F.col(c).alias(c) for c in ("uid", "id", "label", "v")], F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(anchor_strips)).cast("int").alias("part"),
        start.alias("start"), span.alias("span"),
    )
    own = anchors.withColumn("strip", F.explode(F.sequence(F.col("start").cast("bigint"), F.col("start") + F.col("span").cast("bigint") - 1)))
    found = own.groupBy("part", "strip").cogroup(candidates.groupBy("part", "strip")).applyInArrow(
        _positives_of(positives), "uid bigint, score bigint, id bigint"
    )
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "id")
    best = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    # At most `positives` of each anchor.
    lists = best.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("place", "score", "id"))).alias("positives"))
    lists = stored(lists, "negatives-positives")

    everywhere = anchors.join(lists, "uid").drop("start", "span").withColumn(
        "strip", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(first[-1] - 1, 0)).cast("bigint")))
    )
    near = everywhere.groupBy("part", "strip").cogroup(candidates.groupBy("part", "strip")).applyInArrow(
        _negatives_of(negatives, low, high),
        "uid bigint, place bigint, anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint",
    )
    order = Window.partitionBy("uid", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select(
        "anchor_id", "positive_id", (F.col("place") + 1).cast("int").alias("positive_rank"), "rank", "negative_id",
        "positive_score", "negative_score",
    )


def query(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    found = mine(rows, F.col("vec_id") % 100 == 0, label=moved)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same,
         list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a, v b WHERE a.id % 100 = 0 AND a.id <> b.id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id,
       (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10
"""
