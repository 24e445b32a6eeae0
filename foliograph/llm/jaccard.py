"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact sorted-array intersection.

A document's set is that of its five-word shingles, as 64-bit hashes. Documents with equal sets are
one class, of which the smallest id stands for all. Two classes link if their likeness reaches
`percent` hundredths.

Comparing every pair of a size band is quadratic in the corpus, so bands are cut into tiles: a
document lies in the tiles (size band, k, hash of ROWS minima of its set under permutations) for k
below BANDS, and in those of the band below if it is small enough to link with documents there. Two
sets of likeness 0.8 share no tile with a probability of (1 - 0.8^4)^40 = 7e-10, and less above.

Tiles may hold any share of the documents, so their pairs are never listed:

1. every member of a tile is compared with the smallest id in it, what links is united;
2. members that are not united with a tile's pivot, drawn by hash, are compared with it;
3. what is left are pairs of different components within a tile. Tiles are cut into blocks of about
   BLOCK members, pairs of blocks meet in a task, and only pairs that the bitmaps let pass leave it.

A pair is compared in two steps. Each set has a bitmap of BITS bits, one for each hash; every bit in
which two differ stands for a shingle that one lacks, so they share at most (|x| + |y| - differing
bits) / 2 shingles. Where that bound reaches what the link needs, the sorted arrays are intersected.

Components are found by alternately linking all larger neighbours and all smaller ones to the
smallest neighbour (large and small stars), over stored tables.

Stars connect components, but leave most links of a large one unseen. As both ends of a link are in one
component, all links are then read off the components: each is cut into blocks by hash, pairs of
blocks meet in a task with their sorted arrays, and every pair of sets that the bitmaps let pass is
compared exactly. Links are counted in that task, so that no list of a component's pairs is shuffled.

Defined cases: null, empty and blank texts have an empty set and link with nothing; rows that repeat an
id are one document and linked; rows with a null id link with nothing and have no component; other
columns are not needed, and may have any name. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import ascii_lower, slices, space_words, stored, table
from foliograph.llm.fingerprints import shingle_hashes

BANDS, ROWS, BITS, BLOCK = 40, 4, 512, 2048
HASHES = 1 << 20  # about so many in a block whose links are counted
SIZE_STEP = 4  # a size band ends at so many times its beginning
_SEEDS = np.random.default_rng(20240301).integers(0, 1 << 32, size=(2, BANDS * ROWS), dtype=np.uint32)
_MIX = np.random.default_rng(20240302).integers(1, 1 << 63, size=ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SKETCH = "doc long, n int, class string, bits array<long>, bands array<long>"


def shingle_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, hashes): sorted distinct shingle hashes of every row."""
    # No condition on hashes may follow: Spark would move it into the scan, and split texts for each shingle.
    words = space_words(ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    split = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), words.alias("words"))
    return split.select("doc", F.sort_array(shingle_hashes(F.col("words"))).alias("hashes"))


def _minima(hashes: np.ndarray) -> np.ndarray:
    """Minima of a set under all permutations, a few at a time."""
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    out = np.empty(BANDS * ROWS, np.uint32)
    step = max(1, 65536 // len(x))
    for low in range(0, BANDS * ROWS, step):
        high = min(low + step, BANDS * ROWS)
        y = x[None, :] ^ _SEEDS[0, low:high, None]
        y *= (_SEEDS[1, low:high, None] | np.uint32(1))
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        out[low:high] = y.min(axis=1)
    return out


def sketches(sets: DataFrame) -> DataFrame:
    """SKETCH of every row: size, class (digest of the set), bitmap and bands; no bands for empty sets."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in slices(batches):
            column = batch.column("hashes")
            values, ends = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
            sizes, classes = np.diff(ends).astype(np.int32), []
            bits = np.zeros((len(sizes), BITS // 64), np.uint64)
            bands = np.zeros((len(sizes), BANDS), np.uint64)
            for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                own = values[a:b]
                classes.append(hashlib.blake2b(own.tobytes(), digest_size=16).hexdigest())
                if b > a:
                    places = own % np.uint64(BITS)
                    np.bitwise_or.at(bits[i], (places >> np.uint64(6)).astype(np.int64), np.uint64(1) << (places & np.uint64(63)))
                    minima = _minima(own).astype(np.uint64).reshape(BANDS, ROWS)
                    bands[i] = ((minima + np.uint64(1)) * _MIX).sum(axis=1, dtype=np.uint64)
            full = sizes > 0
            lists = lambda m, n: pa.ListArray.from_arrays(pa.array(n, pa.int32()), pa.array(m.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"), pa.array(sizes), pa.array(classes, pa.string()),
                    lists(bits, np.arange(len(sizes) + 1) * (BITS // 64)),
                    lists(bands[full], np.concatenate([[0], np.cumsum(full * BANDS)])),
                ],
                names=["doc", "n", "class", "bits", "bands"],
            )

    return sets.mapInArrow(sketch, SKETCH)


def tiles(reps: DataFrame, percent: int) -> DataFrame:
    """(tile, k, node, n): the tiles of each class."""
    band = F.floor(F.log("n") / F.log(F.lit(float(SIZE_STEP))) + 1e-9)
    # It also meets sets of up to n * percent / 100 in the band below.
    low = (F.col("n") * percent < 100 * F.pow(F.lit(float(SIZE_STEP)), band)) & (band > 0)
    sizes = F.when(low, F.array(band, band - 1)).otherwise(F.array(band))
    sized = reps.withColumn("size", F.explode(sizes)).select("node", "n", "size", F.posexplode("bands").alias("k", "value"))
    return sized.select(F.xxhash64("size", "k", "value").alias("tile"), "k", "node", "n")


def links(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Stored pairs (a, b) that link, of distinct candidate pairs."""
    bits = reps.select("node", "n", "bits")
    first = pairs.join(bits.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a")), "a")
    both = first.join(bits.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b")), "b")
    differing = sum((F.bit_count(F.get("bits_a", F.lit(i)).bitwiseXOR(F.get("bits_b", F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    needed = F.col("na") + F.col("nb")
    may = both.filter((100 + percent) * F.floor((needed - differing) / 2) >= percent * needed).select("a", "b")
    hashed = may.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hashes_b")), "b")
    hashed = hashed.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("hashes_a")), "a")
    common, total = F.size(F.array_intersect("hashes_a", "hashes_b")), F.size("hashes_a") + F.size("hashes_b")
    return stored(hashed.filter((100 + percent) * common >= percent * total).select("a", "b"), "jaccard-links")


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """Stored (node, root): the smallest node of each component, for nodes with edges (a, b)."""
    current = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    shape = None
    for _ in range(limit):
        # Large stars: larger neighbours are linked to the smallest one.
        near = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "stars")
        large = near.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = stored(large, "stars")
        # Small stars: a node and its smaller neighbours are linked to the smallest one.
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "stars")
        small = large.join(least, "a").select("a", "b", "m")
        both = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        current = stored(both.filter("a <> b").distinct(), "stars")
        now = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == shape:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        shape = now
    raise RuntimeError("components did not settle")


def _with_root(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _near_in_group(node, n, root, block, bits, bands, k: int, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of a group of a tile's members whose sizes and bitmaps allow a link and whose roots differ.

    Members of one block are paired with each other, those of two blocks with the other block's. A pair
    comes out of the first tile, by k, that it shares."""
    first = np.flatnonzero(block == block.min())
    second = first if len(first) == len(block) else np.flatnonzero(block != block.min())
    found = []
    for low in range(0, len(first), 256):
        x = first[low:low + 256]
        total = n[x][:, None] + n[second][None, :]
        differing = np.zeros(total.shape, np.int64)
        for word in range(bits.shape[1]):
            differing += np.bitwise_count(bits[x, word][:, None] ^ bits[second, word][None, :])
        near = (100 + percent) * ((total - differing) // 2) >= percent * total
        near &= root[x][:, None] != root[second][None, :]
        near &= 100 * np.minimum(n[x][:, None], n[second][None, :]) >= percent * np.maximum(n[x][:, None], n[second][None, :])
        if second is first:
            near &= node[x][:, None] < node[second][None, :]
        i, j = np.nonzero(near)
        i, j = x[i], second[j]
        own = np.argmax(bands[i] == bands[j], axis=1) == k
        a, b = node[i[own]], node[j[own]]
        found.append((np.minimum(a, b), np.maximum(a, b)))
    return found


def near_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Distinct candidate pairs (a, b) of members (tile, k, count, node, n, root, bits, bands) with different roots."""
    blocks = F.greatest(F.ceil(F.col("count") / BLOCK), F.lit(1))
    own = F.pmod(F.xxhash64("node", F.lit(11)), blocks)
    meets = members.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    grouped = meets.select(
        "tile", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "k", "node", "n", "root",
        F.concat("bits", "bands").alias("bits"),
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs_of(keys: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
            new = np.flatnonzero(np.any(keys[:3, 1:] != keys[:3, :-1], axis=0)) + 1
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for low, high in zip(np.concatenate([[0], new]), np.concatenate([new, [keys.shape[1]]]), strict=True):
                if high - low > 1:
                    block, k, node, n, root = keys[3:, low:high]
                    own, bands = bits[low:high, : BITS // 64], bits[low:high, BITS // 64:]
                    found += _near_in_group(node, n, root, block, own, bands, k[0], percent)
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        width = BITS // 64 + BANDS
        keys, bits = np.zeros((8, 0), np.int64), np.zeros((0, width), np.uint64)
        for batch in batches:
            more = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("tile", "i", "j", "block", "k", "node", "n", "root")])
            flat = batch.column("bits").flatten().to_numpy().view(np.uint64).reshape(-1, width)
            keys, bits = np.concatenate([keys, more], axis=1), np.concatenate([bits, flat])
            # The last group may go on in the next batch.
            others = np.flatnonzero(np.any(keys[:3] != keys[:3, -1:], axis=0))
            end = int(others[-1]) + 1 if len(others) else 0
            if end:
                yield pairs_of(keys[:, :end], bits[:end])
                keys, bits = keys[:, end:], bits[end:]
        if keys.shape[1]:
            yield pairs_of(keys, bits)

    dealt = grouped.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def _grown(found: DataFrame, linked: DataFrame, more: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and components with the new links, if there are any."""
    if more.isEmpty():
        return linked, roots
    linked = linked.union(more)
    return linked, components(found.union(linked))


def _pairs(a: Column, b: Column, na: Column, nb: Column, percent: int) -> list[Column]:
    """Columns of a pair, or nothing if the sizes rule a link out."""
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), (100 * F.least(na, nb) >= percent * F.greatest(na, nb)).alias("fits")]


def _with_class(sets: DataFrame) -> DataFrame:
    """(class, hashes) of sets, as sketches names classes."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in slices(batches):
            column = batch.column("hashes")
            values, ends = column.values.to_numpy(), column.offsets.to_numpy()
            classes = [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.string()), column], names=["class", "hashes"])

    return sets.select("hashes").mapInArrow(name, "class string, hashes array<long>")


def in_blocks(reps: DataFrame, sets: DataFrame) -> DataFrame:
    """(root, i, j, block, class, node, n, rows, bits, hashes): the classes (class, node, n, bits, rows, root) of
    components of several, with their sets, once for each pair (i, j) of blocks that has theirs."""
    sizes = reps.groupBy("root").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("hashes")).filter("count > 1")
    blocks = F.greatest(F.ceil(F.col("count") / BLOCK), F.ceil(F.col("hashes") / HASHES))
    held = reps.join(sizes.select("root", blocks.alias("blocks")), "root")
    # Rows that repeat an id repeat its sets.
    full = held.join(_with_class(sets), "class").dropDuplicates(["class"])
    meets = full.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    )
    return meets.select(
        "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "class", "node", "n", "rows", "bits", "hashes"
    )


def _linked_in_group(n, block, bits, values, ends, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y) of the pairs of a group's sets that link, each once.

    Sets of one block are paired with each other, those of two blocks with the other block's."""
    first = np.flatnonzero(block == block.min())
    second = first if len(first) == len(block) else np.flatnonzero(block != block.min())
    ids = np.unique(values, return_inverse=True)[1]
    own, left, right = np.zeros(ids.max() + 1, np.int32), [], []
    for x in first:
        total = n[x] + n[second]
        differing = np.bitwise_count(bits[x] ^ bits[second]).sum(axis=1, dtype=np.int64)
        near = (100 + percent) * ((total - differing) // 2) >= percent * total
        if second is first:
            near &= second > x
        y = second[near]
        if not len(y):
            continue
        held = ids[ends[x]:ends[x + 1]]
        own[held] = 1
        if 4 * len(y) > len(n):
            common = np.add.reduceat(own[ids], ends[:-1])[y]
        else:
            common = np.array([own[ids[ends[k]:ends[k + 1]]].sum() for k in y])
        own[held] = 0
        y = y[(100 + percent) * common.astype(np.int64) >= percent * (n[x] + n[y])]
        left.append(np.full(len(y), x))
        right.append(y)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _over_groups(members: DataFrame, percent: int, told, schema: str) -> DataFrame:
    """What told(batch, x, y) gives of each group of members, and the places x, y of its pairs that link."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(group: pa.RecordBatch) -> pa.RecordBatch:
            n, block = (group.column(c).to_numpy().astype(np.int64) for c in ("n", "block"))
            bits = group.column("bits").flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64)
            ends = np.concatenate([[0], np.cumsum(n)])
            return told(group, *_linked_in_group(n, block, bits, group.column("hashes").flatten().to_numpy(), ends, percent))

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch if rest is None else pa.concat_batches([rest, batch])
            keys = np.stack([batch.column(c).to_numpy() for c in ("root", "i", "j")])
            starts = np.concatenate([[0], np.flatnonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0)) + 1])
            for low, high in zip(starts[:-1], starts[1:], strict=True):
                yield linked(batch.slice(low, high - low))
            rest = batch.slice(starts[-1])  # it may go on in the next batch
        if rest is not None:
            yield linked(rest)

    dealt = members.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return dealt.mapInArrow(compare, schema)


def all_links(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): the smallest ids of each pair of sets that links, a <= b."""

    def told(group: pa.RecordBatch, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        node = group.column("node").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[x], node[y])), pa.array(np.maximum(node[x], node[y]))], names=["a", "b"])

    return _over_groups(members, percent, told, "a long, b long")


def link_counts(members: DataFrame, percent: int) -> DataFrame:
    """(class, links): how many rows of other sets each class links with; counts are summed over pairs of blocks."""

    def told(group: pa.RecordBatch, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        rows, counts = group.column("rows").to_numpy(), np.zeros(group.num_rows, np.int64)
        np.add.at(counts, x, rows[y])
        np.add.at(counts, y, rows[x])
        return pa.RecordBatch.from_arrays([group.column("class"), pa.array(counts)], names=["class", "links"])

    return _over_groups(members, percent, told, "class string, links long").groupBy("class").agg(F.sum("links").alias("links"))


def _joined(docs: DataFrame, id_col: str, text_col: str, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows (doc, n, class, component), classes (class, node, n, rows), members as of in_blocks)."""
    known = docs.select(F.col(f"`{id_col}`").cast("long").alias("node"), F.col(f"`{text_col}`").alias("body"))
    own = stored(sketches(shingle_sets(docs, id_col, text_col)), "jaccard-sketches")
    filled = own.filter("n > 0 AND doc IS NOT NULL")
    classes = stored(filled.groupBy("class").agg(F.min("doc").alias("node"), F.max("n").alias("n"), F.count(F.lit(1)).alias("rows")), "jaccard-classes")
    chosen = classes.select("class", F.col("node").alias("doc"))
    reps = filled.join(chosen, ["class", "doc"], "left_semi").dropDuplicates(["class"]).select("class", F.col("doc").alias("node"), "n", "bits", "bands")
    reps = stored(reps, "jaccard-classes-bits")
    tiled = tiles(reps, percent)
    shared = stored(
        tiled.groupBy("tile").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("pivot")).filter("members > 1").select("tile", "pivot"),
        "jaccard-tiles",
    )
    members = stored(tiled.join(shared, "tile").select("tile", "k", "node", "n", "pivot"), "jaccard-members")
    wanted = members.select("node").distinct()
    sets = shingle_sets(known.join(wanted, "node", "left_semi"), "node", "body")
    sets = stored(sets.select(F.col("doc").alias("node"), "hashes"), "jaccard-sets")

    # Rows of one id with different texts.
    held = filled.select("doc", "class").join(classes.select("class", "node"), "class").select("doc", "node").distinct()
    several = held.groupBy("doc").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least <> most")
    found = held.join(several, "doc").select(F.col("node").alias("a"), F.col("least").alias("b")).filter("a <> b")

    star = members.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    linked = links(star, reps, sets, percent)
    roots = components(found.union(linked))
    # Pivots drawn by hash, for what the first one did not unite.
    rooted = stored(_with_root(members.select("tile", "k", "node", "n"), roots), "jaccard-rooted")
    mixed = rooted.groupBy("tile").agg(
        F.count(F.lit(1)).alias("count"), F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.struct(F.xxhash64("node", "tile").alias("h"), "node", "root", "n")).alias("p")
    ).filter("low <> high").select("tile", "count", "p")
    mixed = stored(mixed, "jaccard-mixed")
    open_ = rooted.join(mixed, "tile")
    drawn = open_.filter(F.col("root") != F.col("p.root")).select(*_pairs(F.col("node"), F.col("p.node"), F.col("n"), F.col("p.n"), percent))
    more = links(drawn.filter("fits").select("a", "b").distinct(), reps, sets, percent)
    linked, roots = _grown(found, linked, more, roots)
    # All pairs that are left between components within a tile.
    rest = _with_root(open_.select("tile", "k", "count", "node", "n"), roots).join(reps.select("node", "bits", "bands"), "node")
    more = links(near_pairs(rest, percent), reps, sets, percent)
    _, roots = _grown(found, linked, more, roots)

    placed = own.select("doc", "n", "class").join(_with_root(classes.select("class", "node"), roots).select("class", "root"), "class", "left")
    rows = placed.select("doc", "n", "class", F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc")).alias("component"))
    rows = rows.withColumn("component", F.when(F.col("doc").isNotNull(), F.col("component")))
    held = reps.join(classes.select("class", "rows"), "class").select("class", "node", "n", "bits", "rows")
    return rows, classes, in_blocks(_with_root(held, roots), sets)


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(rows (doc, n, component), links (a, b) between class representatives).

    One row for each row of docs; component is the smallest id that links reach. links has each pair of
    different sets that links, once; it is computed when read."""
    rows, _, members = _joined(docs, id_col, text_col, percent)
    return rows.drop("class"), all_links(members, percent)


def join_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """(doc, n, component, links), one row for each row of docs; links is the number of other rows, with an
    equal set or another, that it links with."""
    rows, classes, members = _joined(docs, id_col, text_col, percent)
    others = link_counts(members, percent).withColumnRenamed("links", "others")
    counted = classes.join(others, "class", "left").select("class", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    links = F.when(F.col("doc").isNotNull() & (F.col("n") > 0), F.col("links")).otherwise(F.lit(0)).cast("long")
    return rows.join(stored(counted, "jaccard-counts"), "class", "left").select("doc", "n", "component", links.alias("links"))


def query(spark, sf_dir: str) -> DataFrame:
    rows = join_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"), F.col("links").alias("n_links"),
    )
