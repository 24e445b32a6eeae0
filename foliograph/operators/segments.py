"""A full-text index of immutable segments, kept up to date by commits and searched with block bounds.

Each commit writes one segment: the postings of the pages it adds or replaces, and which rows of older
segments it makes dead. A manifest file lists the segments of each version, with the analyser they
were built with; a version is readable only once its file is there. Segments of alike size are merged, dead
rows left out, so their number stays logarithmic in the pages.

The terms of a page are counted and placed inside its row. Rows of pages are dealt by slice, and only then become
postings: rows sorted by storage bucket, term, impact level and slice of documents; those of one such place are a block,
and lie in one file. The header of a block has its largest frequency and shortest document, which bound every score in it. A top-k query reads the
headers first, finds a score that k pages reach, and then reads only blocks that can hold a better page; of those of
terms that are too frequent to lift a page there, only the postings of pages that other terms found.
Postings carry positions, so that a phrase is found where its words stand next to each other.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from foliograph import constants as K
from foliograph.functions import pages as P
from foliograph.functions.porter import stems
from foliograph.functions.text import computed, let
from foliograph.operators.graph import subdir_rank
from foliograph.operators.grouping import top_k
from foliograph.operators.index import FIELDS, analysed, searchable
from foliograph.operators.retrieval import expansion_ranks, fuse, query_terms
from foliograph.session import is_missing_path, persist_durably

KEY = ("subdir", "name")
LEVELS = 16
SLICE_PAGES = 4096  # pages in a slice, on average
BUCKET_TOKENS = 1 << 16  # tokens in a storage bucket, on average; files are sorted by bucket, so that readers skip to theirs
TASK_TOKENS = 1 << 20  # tokens that a task sorts and writes, on average
TIER = 4  # segments of one size tier that are merged
FIELD_STRIDE = 1 << 32  # positions of the next field begin here
MARGIN = 1e-6  # scores are ranked by nine decimals

MANIFEST_FOLDER = "manifest-rows"  # an index whose blocks hold their postings is not read, but built again
MANIFEST = "version long, segment string, ord int, pages long, tokens long, slices int, buckets int, stemmed boolean, source long"
BLOCKS = "term string, level int, slice int, n int, max_f double, min_dl long, bucket int"
POSTINGS = "term string, level int, slice int, subdir string, name string, dl long, f double, positions array<bigint>, bucket int"
DOCS = "subdir string, name string, digest long, dl long, terms array<string>, links array<string>"
DEAD = "segment string, subdir string, name string, dl long, terms array<string>"


def saturation(f: Column, dl: Column, average: Column) -> Column:
    """Weightless BM25 part of a posting: grows with f, falls with dl."""
    return f * (K.BM25_K1 + 1) / (f + K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * dl / average))


def field_weight(place: Column) -> Column:
    return F.get(F.array(*[F.lit(K.BM25_WEIGHTS[f]) for f in FIELDS]), F.floor(place / FIELD_STRIDE).cast("int"))


def slice_of(slices: Column) -> Column:
    return F.pmod(F.xxhash64(*KEY), slices).cast("int")


def bucket_of(term: Column, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(term), buckets).cast("int")


def page_entries(tokens: DataFrame, *keep: str) -> DataFrame:
    """(key, dl, keep, postings: (term, f, positions) in order of terms) of analysed pages: one row per page.

    The places of a page's words are sorted inside the row; a term's are those up to the next term."""

    def placed(field: str) -> Column:
        first = F.lit(FIELDS.index(field) * FIELD_STRIDE).cast("long")
        return F.transform(f"t_{field}", lambda t, i: F.struct(t.alias("term"), (i + first).alias("place")))

    def weighed(places: Column) -> Column:
        last = F.lit((len(FIELDS) - 1) * FIELD_STRIDE)
        alike = F.size(places) * F.lit(K.BM25_WEIGHTS[FIELDS[-1]])  # all in the last field
        return F.when(F.get(places, F.lit(0)) >= last, alike).otherwise(
            F.aggregate(places, F.lit(0.0), lambda total, place: total + field_weight(place))
        )

    def entries(words: Column) -> Column:
        new = F.transform(words, lambda w, i: F.when((i == 0) | (F.get(words, i - 1)["term"] != w["term"]), i))
        return let(F.filter(new, lambda i: i.isNotNull()), lambda starts: let(words["place"], lambda places: F.transform(
            starts, lambda at, i: let(
                F.slice(places, at + 1, F.coalesce(F.get(starts, i + 1), F.size(words)) - at),
                lambda own: F.struct(F.get(words, at)["term"].alias("term"), weighed(own).alias("f"), own.alias("positions")),
            ),
        )))

    words = F.sort_array(F.concat(*map(placed, FIELDS)))
    return tokens.select(*KEY, F.col("dl").cast("long").alias("dl"), *keep, let(words, entries).alias("postings"))


def regrouped(entries: DataFrame, stemmed: bool = False) -> DataFrame:
    """(key, dl, postings) of page entries whose terms become their stems, or whose keys repeat: pages of one key and length
    are one. Stems are found once for each distinct word and joined to the words of pages."""
    rows = entries.select(*KEY, "dl", F.inline("postings"))
    if stemmed:
        known = stems(rows.select(F.col("term").alias("word")))
        rows = rows.join(known.withColumnRenamed("word", "term"), "term").withColumn("term", F.col("stem"))
    places = F.sort_array(F.flatten(F.collect_list("positions")))
    rows = rows.groupBy(*KEY, "dl", "term").agg(F.sum("f").alias("f"), places.alias("positions"))
    return rows.groupBy(*KEY, "dl").agg(F.collect_list(F.struct("term", "f", "positions")).alias("postings"))


def placed_postings(postings: DataFrame, buckets: int, average: float) -> DataFrame:
    """Postings of slices with their block: (term, level, slice), and its storage bucket."""
    impact = saturation(F.col("f"), F.col("dl"), F.lit(average)) / (K.BM25_K1 + 1)
    level = F.least(F.floor((1 - impact) * LEVELS), F.lit(LEVELS - 1)).cast("int")
    return postings.withColumns({"level": level, "bucket": bucket_of(F.col("term"), F.lit(buckets))})


def headers_of(placed: DataFrame) -> DataFrame:
    """(term, level, slice, n, max_f, min_dl, bucket): one row per block. A block holds at most the pages of a slice."""
    return placed.groupBy("bucket", "term", "level", "slice").agg(
        F.count("*").cast("int").alias("n"), F.max("f").alias("max_f"), F.min("dl").alias("min_dl")
    ).select("term", "level", "slice", "n", "max_f", "min_dl", "bucket")


class SegmentIndex:
    """The segments of one index folder. One writer at a time; readers keep the version they opened."""

    def __init__(self, spark: SparkSession, path: str, stemmed: bool = True, slice_pages: int = SLICE_PAGES):
        self.spark, self.path, self.stemmed, self.slice_pages = spark, path.rstrip("/"), stemmed, slice_pages
        self.version, self.segments, self.source = self._listed()
        if any(s.stemmed != stemmed for s in self.segments):
            raise ValueError("this index was built with another analyser")

    def _listed(self) -> tuple[int, list[Row], int | None]:
        """Newest version, its segments, oldest first (at most a few dozen rows), and what it was synced with."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/{MANIFEST_FOLDER}")
            version = rows.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
        except AnalysisException as e:
            if not is_missing_path(e):
                raise
            return 0, [], None
        found = rows.filter(F.col("version") == version).collect()
        segments = sorted((r for r in found if r.segment is not None), key=lambda s: s.ord)
        return version, segments, found[0].source if found else None

    def _publish(self, segments: list[Row]) -> None:
        """List a version; a version without segments is one row without a segment."""
        version = self.version + 1
        rows = [(version, s.segment, i, s.pages, s.tokens, s.slices, s.buckets, s.stemmed, self.source) for i, s in enumerate(segments)]
        rows = rows or [(version, *[None] * 7, self.source)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/{MANIFEST_FOLDER}")
        self.version, self.segments, self.source = self._listed()

    def _folder(self, segment: str, table: str) -> str:
        return f"{self.path}/segments/{segment}/{table}"

    def _union(self, table: str, schema: str, segments: Sequence[Row] | None = None) -> DataFrame:
        """A table of all live segments, with the segment's name."""
        parts = [
            self.spark.read.schema(schema).parquet(self._folder(s.segment, table)).withColumn("of", F.lit(s.segment))
            for s in (self.segments if segments is None else segments)
        ]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{schema}, of string")

    # --- writing ---------------------------------------------------------------------------

    def commit(self, pages: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
        """Add or replace pages (subdir, name, content; one row per key) and delete others (subdir, name) as one
        new version. Only the new segment is written; sizes then decide on merges."""
        empty = self.spark.createDataFrame([], "subdir string, name string, content string")
        pages = (pages if pages is not None else empty).select(*KEY, computed(F.col("content")).alias("content"))
        fields = searchable(pages, F.xxhash64("content").alias("digest"), P.link_targets(F.col("content")).alias("links"))
        # One pass over the texts: what is stored are the words of each page.
        read = persist_durably(page_entries(analysed(fields, [*KEY, "digest", "links"]), "digest", "links"), "index-pages")
        gone = read.select(*KEY)
        if deleted is not None:
            gone = gone.unionByName(deleted.select(*KEY)).distinct()
        name = uuid.uuid4().hex
        older = self.docs().join(gone, list(KEY), "left_semi")
        older.select(F.col("of").alias("segment"), *KEY, "dl", "terms").write.parquet(self._folder(name, "dead"))
        entries, docs = self._grouped(read)
        docs.write.parquet(self._folder(name, "docs"))
        segment = self._written(name, entries)
        self._publish([*self.segments, segment])
        self.compact()

    def _grouped(self, read: DataFrame) -> tuple[DataFrame, DataFrame]:
        """((key, dl, postings), docs) of stored page entries. Only pages whose terms change or whose key repeats are shuffled."""
        alone = None
        if not self.stemmed:
            again = persist_durably(read.groupBy(*KEY).agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "repeated-keys")
            known = F.col("postings.term").alias("terms")
            alone, docs = read, read.dropna(subset=list(KEY)).select(*KEY, "digest", "dl", known, "links")
            if again.isEmpty():
                return alone, docs
            match = reduce(Column.__and__, [read[k].eqNullSafe(again[k]) for k in KEY])
            alone, read = read.join(again, match, "left_anti"), read.join(again, match, "left_semi")
            docs = alone.dropna(subset=list(KEY)).select(*KEY, "digest", "dl", known, "links")
        entries = persist_durably(regrouped(read, self.stemmed), "index-entries")
        terms = entries.groupBy(*KEY).agg(F.flatten(F.collect_list("postings.term")).alias("terms"))
        terms = read.select(*KEY, "dl").join(terms, list(KEY), "left").join(read.select(*KEY, "digest", "links"), list(KEY))
        terms = terms.withColumn("terms", F.coalesce("terms", F.array().cast("array<string>"))).select(*KEY, "digest", "dl", "terms", "links")
        return (entries, terms) if alone is None else (alone.select(*entries.columns).unionByName(entries), docs.unionByName(terms))

    def sync(self, pages: DataFrame, source: int | None = None) -> None:
        """Commit the difference between pages (subdir, name, content; one row per key) and the live ones. Pages are
        compared by key and a hash of their text; only changed texts are read on. ``source`` is the number of the
        version that pages are of: an index that was synced with it is left alone, without reading a page."""
        if source is not None and source == self.source:
            return
        held = self.docs().select(*KEY, "digest")
        same = (pages["subdir"] == held["subdir"]) & (pages["name"] == held["name"]) & (F.xxhash64(pages["content"]) == held["digest"])
        changed = persist_durably(pages.join(held, same, "left_anti").select(*KEY, "content"), "changed-pages")
        deleted = persist_durably(held.select(*KEY).join(pages.select(*KEY), list(KEY), "left_anti"), "deleted-pages")
        differs = not (changed.isEmpty() and deleted.isEmpty())
        self.source = source if source is not None else self.source
        if differs:
            self.commit(changed, deleted)
        elif source is not None:
            self._publish(self.segments)

    def _written(self, name: str, found: DataFrame) -> Row:
        """Write postings and block headers of a segment whose docs are written; its manifest row. ``found`` are the
        postings, by page or as rows."""
        sizes = self.spark.read.schema(DOCS).parquet(self._folder(name, "docs")).agg(
            F.count("*").alias("pages"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")
        ).first()
        slices = max(1, -(-sizes.pages // self.slice_pages))
        buckets = max(1, -(-sizes.tokens // BUCKET_TOKENS))
        average = sizes.tokens / sizes.pages if sizes.tokens else 1.0
        parts = max(1, -(-sizes.tokens // TASK_TOKENS))
        # A slice lies in one task, so that its blocks are whole there, and a frequent term is many tasks' work.
        sliced = found.withColumn("slice", slice_of(F.lit(slices)))
        whole, narrow = sliced, sliced.select("slice", "dl", "term", "f") if "term" in sliced.columns else sliced.select(
            "slice", "dl", F.arrays_zip("postings.term", "postings.f").alias("postings"))
        whole, narrow = (
            placed_postings(df if "term" in df.columns else df.select(*[c for c in df.columns if c != "postings"], F.inline("postings")), buckets, average)
            for df in (whole.repartition(parts, "slice"), narrow.repartition(parts, "slice"))
        )
        order = ["bucket", "term", "level", "slice"]
        columns = ["term", "level", "slice", *KEY, "dl", "f", "positions", "bucket"]
        whole.select(*columns).sortWithinPartitions(*order).write.parquet(self._folder(name, "postings"))
        headers_of(narrow).sortWithinPartitions(*order).write.parquet(self._folder(name, "blocks"))
        return Row(segment=name, ord=0, pages=sizes.pages, tokens=sizes.tokens, slices=slices, buckets=buckets, stemmed=self.stemmed)

    def compact(self) -> None:
        """Merge the newest segments while TIER of them are within one tier of sizes, or one is empty."""
        while True:
            run = self._mergeable()
            if not run:
                return
            at = self.segments.index(run[0])
            self._publish([*self.segments[:at], self._merged(run), *self.segments[at + len(run):]])

    def _mergeable(self) -> list[Row]:
        """The longest newest run of segments none of which is larger than TIER times all behind it."""
        run: list[Row] = []
        for s in reversed(self.segments):
            if run and s.pages > TIER * sum(r.pages for r in run):
                break
            run.insert(0, s)
        return run if len(run) >= TIER else []

    def _merged(self, run: list[Row]) -> Row:
        """One segment with the live rows of consecutive segments."""
        name, members = uuid.uuid4().hex, [s.segment for s in run]
        dead = self.dead().select(F.col("segment").alias("of"), *KEY)
        docs = self._union("docs", DOCS, run).join(dead, ["of", *KEY], "left_anti")
        docs.select(*KEY, "digest", "dl", "terms", "links").write.parquet(self._folder(name, "docs"))
        # What the members made dead in segments that stay.
        kills = self._union("dead", DEAD, run).filter(~F.col("segment").isin(members))
        kills.drop("of").write.parquet(self._folder(name, "dead"))
        rows = self._union("postings", POSTINGS, run)
        live = rows.join(dead, ["of", *KEY], "left_anti").select(*KEY, "dl", "term", "f", "positions")
        return self._written(name, live)

    # --- reading ---------------------------------------------------------------------------

    def dead(self) -> DataFrame:
        """(segment, key, dl, terms) of rows in live segments that a later commit replaced or deleted."""
        return self._union("dead", DEAD).filter(F.col("segment").isin([s.segment for s in self.segments])).drop("of")

    def docs(self) -> DataFrame:
        """(of, key, dl, terms, links) of the live pages."""
        gone = self.dead().select(F.col("segment").alias("of"), *KEY)
        return self._union("docs", DOCS).join(gone, ["of", *KEY], "left_anti")

    def stats(self) -> Row:
        """Number of live pages and their average length, from the manifest and the dead rows."""
        gone = self.dead().agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
        pages = sum(s.pages for s in self.segments) - gone.n
        tokens = sum(s.tokens for s in self.segments) - gone.tokens
        return Row(n_docs=pages, avgdl=tokens / pages if tokens else 1.0)

    def blocks(self, terms: DataFrame) -> DataFrame:
        """Block headers of the given (distinct) terms, with their segment; other storage buckets are not read."""
        return self._of_terms("blocks", BLOCKS, terms)

    def entries(self, terms: DataFrame) -> DataFrame:
        """(of, term, level, slice, key, dl, f, positions): postings of the given (distinct) terms, dead ones too."""
        return self._of_terms("postings", POSTINGS, terms)

    def _of_terms(self, table: str, schema: str, terms: DataFrame) -> DataFrame:
        parts = []
        for s in self.segments:
            wanted = terms.select("term", bucket_of(F.col("term"), F.lit(s.buckets)).alias("in_bucket"))
            read = self.spark.read.schema(schema).parquet(self._folder(s.segment, table))
            if s.buckets > 1:
                read = read.filter(F.col("bucket").isin([r[0] for r in wanted.select("in_bucket").distinct().collect()]))
            parts.append(read.join(wanted.drop("in_bucket"), "term").drop("bucket").withColumn("of", F.lit(s.segment)))
        schema = f"{schema.rsplit(',', 1)[0]}, of string"
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def live(self, postings: DataFrame) -> DataFrame:
        """Postings (of, key, ...) without those of dead rows."""
        return postings.join(self.dead().select(F.col("segment").alias("of"), *KEY), ["of", *KEY], "left_anti")

    def document_frequency(self, terms: DataFrame, headers: DataFrame) -> DataFrame:
        """(term, df) of single words over live pages: block counts less the dead rows' terms."""
        counted = headers.groupBy("term").agg(F.sum("n").alias("n"))
        lost = self.dead().select(F.explode("terms").alias("term")).join(terms, "term", "left_semi")
        lost = lost.groupBy("term").agg(F.count("*").alias("lost"))
        df = counted.join(lost, "term", "left").select("term", (F.col("n") - F.coalesce("lost", F.lit(0))).alias("df"))
        return df.filter("df > 0")

    def postings(self) -> DataFrame:
        """(key, dl, term, f, positions) of all live pages. Segments without dead rows are read as they are."""
        changed = {r.segment for r in self.dead().select("segment").distinct().collect()}
        older, whole = ([s for s in self.segments if (s.segment in changed) == c] for c in (True, False))
        rows = self._union("postings", POSTINGS, whole).unionByName(self.live(self._union("postings", POSTINGS, older)))
        return rows.select(*KEY, "dl", "term", "f", "positions")


# --- search ----------------------------------------------------------------------------------


def phrase_postings(index: SegmentIndex, phrases: DataFrame) -> DataFrame:
    """(of, key, dl, term, f) of phrases (distinct terms of several words): places where their words are adjacent."""
    words = phrases.select("term", F.size(F.split("term", " ")).alias("words"), F.posexplode(F.split("term", " ")).alias("i", "word"))
    entries = index.entries(words.select(F.col("word").alias("term")).distinct()).withColumnRenamed("term", "word")
    starts = F.transform("positions", lambda p: p - F.col("i"))
    rows = entries.select("of", "word", *KEY, "dl", "positions").join(words, "word").select("term", "of", *KEY, "dl", "words", starts.alias("starts"))
    # Pages that hold every word of a phrase; only their positions are compared.
    whole = rows.groupBy("term", "of", *KEY, "dl", "words").agg(F.collect_list("starts").alias("starts")).filter(F.size("starts") == F.col("words"))
    once = lambda s: F.filter(s, lambda v, i: ~F.get(s, i - 1).eqNullSafe(v) & F.get(s, i + F.col("words") - 1).eqNullSafe(v) & ~F.get(s, i + F.col("words")).eqNullSafe(v))
    met = let(F.sort_array(F.flatten("starts")), once)  # starts that as many words have as the phrase holds
    found = whole.select("term", "of", *KEY, "dl", met.alias("met")).filter(F.size("met") > 0)
    f = F.aggregate("met", F.lit(0.0), lambda total, start: total + field_weight(start))
    return index.live(found.select("term", "of", *KEY, "dl", f.alias("f")))


def _idf(df: Column, n: int) -> Column:
    idf = F.log((F.lit(n) - df + 0.5) / (df + 0.5))
    return F.when(idf <= 0, F.lit(K.BM25_MIN_IDF)).otherwise(idf)


def bounds(index: SegmentIndex, queries: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """(bounded blocks, phrase scores, average length) for the terms of queries.

    Bounded blocks: (query_id, of, term, level, slice, n, weight, bound). Phrase scores: (query_id, of, key, slice, part)."""
    stats = index.stats()
    single = terms.filter(~F.contains("term", F.lit(" ")))
    vocabulary = persist_durably(single.select("term").distinct(), "vocabulary")
    headers = persist_durably(index.blocks(vocabulary), "block-bounds")
    df = index.document_frequency(vocabulary, headers)
    weighted = single.join(df, "term").select("query_id", "term", (F.col("times") * _idf(F.col("df"), stats.n_docs)).alias("weight"))
    bound = F.col("weight") * saturation(F.col("max_f"), F.col("min_dl"), F.lit(stats.avgdl))
    bounded = headers.join(weighted, "term").select("query_id", "of", "term", "level", "slice", "n", "weight", bound.alias("bound"))

    phrases = terms.filter(F.contains("term", F.lit(" ")))
    found = persist_durably(phrase_postings(index, phrases.select("term").distinct()), "phrase-postings")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    weighted = phrases.join(df, "term").select("query_id", "term", (F.col("times") * _idf(F.col("df"), stats.n_docs)).alias("weight"))
    slices = index.spark.createDataFrame([(s.segment, s.slices) for s in index.segments], "of string, slices int")
    part = F.col("weight") * saturation(F.col("f"), F.col("dl"), F.lit(stats.avgdl))
    scored = found.join(weighted, "term").join(slices, "of")
    return bounded, scored.select("query_id", "of", *KEY, slice_of(F.col("slices")).alias("slice"), "term", part.alias("part")), stats.avgdl


def _parts(index: SegmentIndex, chosen: DataFrame, average: float) -> DataFrame:
    """(query_id, of, key, slice, part) of the live postings of chosen (query_id, of, term, level, slice, weight)."""
    names = persist_durably(chosen.select("of", "term", "level", "slice").distinct(), "chosen-blocks")
    read = index.entries(names.select("term").distinct()).join(names, ["of", "term", "level", "slice"], "left_semi")
    rows = index.live(read.select("of", "term", "level", "slice", *KEY, "dl", "f"))
    part = F.col("weight") * saturation(F.col("f"), F.col("dl"), F.lit(average))
    return rows.join(chosen, ["of", "term", "level", "slice"]).select("query_id", "of", *KEY, "slice", part.alias("part"))


def _kth(sums: DataFrame, k: int) -> DataFrame:
    """(query_id, reached): the score that k pages of (query_id, key, sum) reach; none for queries with fewer."""
    best = top_k(sums, ["query_id"], [F.col("sum").desc(), F.col("name"), F.col("subdir")], k).filter(F.col("rank") == k)
    return best.select("query_id", F.col("sum").alias("reached"))


def reached_scores(index: SegmentIndex, bounded: DataFrame, phrases: DataFrame, average: float, k: int) -> DataFrame:
    """(query_id, reached): a score that k pages reach, by the phrases and the blocks of the highest bounds."""
    best = top_k(bounded, ["query_id"], [F.col("bound").desc(), F.col("of"), F.col("term"), F.col("level"), F.col("slice")], 2 * k)
    seen = _parts(index, best.select("query_id", "of", "term", "level", "slice", "weight"), average).select("query_id", "of", *KEY, "part")
    sums = seen.unionByName(phrases.select("query_id", "of", *KEY, "part")).groupBy("query_id", *KEY).agg(F.sum("part").alias("sum"))
    return _kth(sums, k)


def _largest(bounded: DataFrame, phrases: DataFrame) -> DataFrame:
    """(query_id, of, slice, term, largest): the highest bound of a term in a slice."""
    each = bounded.select("query_id", "of", "slice", "term", "bound").unionByName(
        phrases.select("query_id", "of", "slice", "term", F.col("part").alias("bound"))
    )
    return each.groupBy("query_id", "of", "slice", "term").agg(F.max("bound").alias("largest"))


def useful_blocks(
    index: SegmentIndex, bounded: DataFrame, phrases: DataFrame, average: float, k: int, reached: DataFrame | None = None
) -> DataFrame:
    """The bounded blocks that can hold one of the best k pages of their query.

    A page of a block scores at most the block's bound and, for every other term, the largest bound in its slice. Blocks
    for which that is below a score that k pages reach are left out."""
    reached = reached_scores(index, bounded, phrases, average, k) if reached is None else reached
    largest = _largest(bounded, phrases)
    whole = largest.groupBy("query_id", "of", "slice").agg(F.sum("largest").alias("whole"))
    place = ["query_id", "of", "slice"]
    tried = bounded.join(largest, [*place, "term"]).join(whole, place).join(reached, "query_id", "left")
    most = F.col("bound") + F.col("whole") - F.col("largest")
    return tried.filter(F.col("reached").isNull() | (most >= F.col("reached") - MARGIN)).select(*bounded.columns)


def best_scores(index: SegmentIndex, chosen: DataFrame, phrases: DataFrame, reached: DataFrame, average: float, k: int) -> DataFrame:
    """(query_id, key, score) of the pages that can be among the best k, from useful blocks.

    The terms of a slice whose largest bounds together stay below the score that k pages reach lift no page to it
    alone. Pages are found by the other terms; the postings of these are read only for pages that can still get there."""
    place = ["query_id", "of", "slice"]
    upto = F.sum("largest").over(Window.partitionBy(*place).orderBy("largest", "term").rowsBetween(Window.unboundedPreceding, 0))
    terms = _largest(chosen, phrases).withColumn("upto", upto).join(reached, "query_id", "left")
    minor = persist_durably(
        terms.withColumn("minor", F.coalesce(F.col("upto") < F.col("reached") - MARGIN, F.lit(False))).filter("minor").select(*place, "term", "upto"),
        "minor-terms",
    )
    lesser = minor.select(*place, "term")
    finding = chosen.join(lesser, [*place, "term"], "left_anti").drop("bound", "n")
    columns = ["query_id", "of", *KEY, "slice"]
    parts = _parts(index, finding, average).unionByName(phrases.select(*columns, "part"))
    sums = persist_durably(parts.groupBy(*columns).agg(F.sum("part").alias("sum")), "first-sums")
    more = minor.groupBy(*place).agg(F.max("upto").alias("more"))
    again = _kth(sums, k).withColumnRenamed("reached", "again")
    least = F.greatest("reached", "again") - MARGIN
    tried = sums.join(more, place, "left").join(reached, "query_id", "left").join(again, "query_id", "left")
    able = F.coalesce(F.col("sum") + F.coalesce("more", F.lit(0.0)) >= least, F.lit(True))
    left = persist_durably(tried.filter(able).select(*columns, "sum"), "able-pages")
    # These pages are live, and few: the postings of frequent terms meet them before they meet the queries.
    rest = chosen.join(lesser, [*place, "term"], "left_semi").join(left.select(*place).distinct(), place, "left_semi")
    rest = persist_durably(rest.select(*place, "term", "level", "weight"), "minor-blocks")
    read = index.entries(rest.select("term").distinct()).select("of", "term", "level", "slice", *KEY, "dl", "f")
    pages = left.select("of", *KEY).distinct().withColumnsRenamed({"of": "l_of", **{c: f"l_{c}" for c in KEY}})
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"l_{c}")) for c in ("of", *KEY)])
    near = read.join(pages, same).drop(*pages.columns)
    part = F.col("weight") * saturation(F.col("f"), F.col("dl"), F.lit(average))
    added = near.join(rest, ["of", "term", "level", "slice"]).select(*columns, part.alias("part"))
    scores = left.withColumnRenamed("sum", "part").withColumn("found", F.lit(1)).unionByName(added.withColumn("found", F.lit(0)))
    scores = scores.groupBy(*columns).agg(F.sum("part").alias("score"), F.max("found").alias("found")).filter("found = 1")
    return scores.groupBy("query_id", *KEY).agg(F.sum("score").alias("score"))


def top_pages(queries: DataFrame, index: SegmentIndex, k: int, prune: bool = True) -> DataFrame:
    """(query_id, subdir, name, score, rank): best k live pages of every query by BM25."""
    terms = persist_durably(query_terms(queries, index.stemmed), "query-terms")
    bounded, phrases, average = bounds(index, queries, terms)
    bounded = persist_durably(bounded, "bounds")
    phrases = persist_durably(phrases, "phrase-scores")
    if prune:
        reached = persist_durably(reached_scores(index, bounded, phrases, average, k), "reached")
        chosen = persist_durably(useful_blocks(index, bounded, phrases, average, k, reached), "useful-blocks")
        scores = best_scores(index, chosen, phrases, reached, average, k)
    else:
        parts = _parts(index, bounded.drop("bound", "n"), average).unionByName(phrases.select("query_id", "of", *KEY, "slice", "part"))
        scores = parts.groupBy("query_id", *KEY).agg(F.sum("part").alias("score"))
    return top_k(scores, ["query_id"], [F.round("score", 9).desc(), F.col("name"), F.col("subdir")], k)


def linked_hits(seeds: DataFrame, index: SegmentIndex) -> DataFrame:
    """(query_id, name, hits) of pages one link away from seeds, from the stored link texts of live pages."""
    docs = index.docs().select(*KEY, "links")
    # One page per name: the later page kind.
    names = docs.select(*KEY).groupBy("name").agg(F.max(subdir_rank(F.col("subdir"))).alias("top"))
    keys = names.groupBy(F.lower("name").alias("link_key")).agg(F.max("name").alias("dst"))
    links = docs.join(names, "name").filter(F.coalesce(subdir_rank(F.col("subdir")) == F.col("top"), F.col("top").isNull()))
    links = links.select(F.col("name").alias("src"), F.explode("links").alias("link_text")).withColumn("link_key", F.lower("link_text"))
    counted = persist_durably(seeds.groupBy("query_id", "name").agg(F.count("*").alias("times")), "seeds")
    wanted = counted.select("name").distinct()
    # Only links from or to a seed are resolved.
    out = links.join(wanted.select(F.col("name").alias("src")), "src", "left_semi").join(keys, "link_key")
    into = links.join(wanted.select(F.lower("name").alias("link_key")).distinct(), "link_key", "left_semi").join(keys, "link_key")
    into = into.join(wanted.select(F.col("name").alias("dst")), "dst", "left_semi")
    near = out.select(F.col("src").alias("name"), F.col("dst").alias("neighbour")).unionByName(
        into.select(F.col("dst").alias("name"), F.col("src").alias("neighbour"))
    )
    near = near.filter("name <> neighbour").distinct()
    hits = counted.join(near, "name").groupBy("query_id", F.col("neighbour").alias("name")).agg(F.sum("times").alias("hits"))
    return hits.join(counted, ["query_id", "name"], "left_anti")


def search(queries: DataFrame, index: SegmentIndex, k: int = K.TOP_K, expand: bool = True) -> DataFrame:
    """(query_id, name, score, rank) as retrieval.search() gives it over the live pages; no page text is read."""
    hits = persist_durably(top_pages(queries, index, 2 * k), "hits")
    if not expand:
        return hits.filter(F.col("rank") <= k).select("query_id", "name", "score", "rank")
    seeds = hits.filter(F.col("rank") <= K.SEED_COUNT).select("query_id", "name")
    near = persist_durably(linked_hits(seeds, index), "expansion")
    fused = fuse(hits, expansion_ranks(near, hits, k))
    return top_k(fused, ["query_id"], [F.round("score", 12).desc(), F.col("name")], k).select("query_id", "name", "score", "rank")
