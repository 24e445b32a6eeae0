"""Quality classifier: document evidence combined with host and path posteriors by empirical Bayes.

1. Shape features of a text (capitals, symbols, words without letters, repeated words, line and
   word lengths) fall into bins. The log-odds of each bin come from counts over all labelled
   rows (of very many, over a sample), with a prior that spreads `prior_rows` rows over the bins of a feature. Their sum is the
   evidence of a document.
2. Hosts: each document counts as good by its label, or else by its probability under the global
   rate. A host's rate is shrunk toward the global one with a strength estimated by moments from
   how much rates differ between hosts; a path's rate likewise toward its host's. Both are sums
   by group, added up before the shuffle. A document's own share is left out of its priors.
3. The probability that a document is good joins its evidence with the prior of its path.

The counts of (1) are at most FEATURES * BINS rows, the only thing that goes to the driver beside
single sums. Hosts and paths are tables; they are joined by key.

Defined cases: a null text is an empty one; null hosts and paths are groups of their own; a label
that is null or neither 0 nor 1 counts as none; without labels of both kinds the evidence is 0 and
the global rate 1/2 (or that of the only kind, smoothed); repeated rows each count; several labels
of one id count with their mean; other columns but the text come back unchanged in `doc`, and `digest`
tells the rows of one id apart.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import packed, sampled, space_words, stored, table, unpacked

BINS = 24
FEATURES = ("capitals", "symbols", "wordless", "distinct", "word_length", "line_length")


def _chars(text: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(text, pattern, ""))


def _bin(value: Column) -> Column:
    return F.least(F.greatest(F.floor(value), F.lit(0)), F.lit(BINS - 1)).cast("int")


def with_bins(docs: DataFrame, text: Column) -> DataFrame:
    """docs with an array `bins`, one for each of FEATURES."""
    letters, solid = _chars(text, r"[^\p{L}]+"), _chars(text, r"\s+")
    words = space_words(text)
    base = docs.withColumns({
        "_solid": solid, "_letters": letters, "_capitals": _chars(text, r"[^\p{Lu}]+"),
        "_symbols": _chars(text, r"[\p{L}\p{N}\s]+"), "_words": words,
        "_lines": F.size(F.split(text, "\n")),
    })
    one = F.lit(1.0)
    n = F.size("_words")
    wordless = F.size(F.filter("_words", lambda w: ~w.rlike(r"\p{L}")))
    # Long texts repeat words anyway: the share of distinct words is taken relative to their length.
    distinct = F.size(F.array_distinct("_words")) / F.greatest(n, one)
    values = {
        "capitals": 8 * F.col("_capitals") / F.greatest("_letters", one),
        "symbols": 40 * F.col("_symbols") / F.greatest("_solid", one),
        "wordless": 20 * wordless / F.greatest(n, one),
        "distinct": 3 * F.floor(F.log10(F.greatest(n, one)) * 1.6) + F.floor(F.least(distinct, F.lit(0.999)) * 3),
        "word_length": F.col("_solid") / F.greatest(n, one),
        "line_length": F.log2(1 + n / F.col("_lines")) * 3,
    }
    binned = base.withColumn("bins", F.array(*[_bin(values[f]) for f in FEATURES]))
    return binned.drop("_solid", "_letters", "_capitals", "_symbols", "_words", "_lines")


def bin_weights(labelled: DataFrame, prior_rows: float) -> list[list[float]]:
    """Log-odds of good against bad for each bin of each feature, from (bins, good, bad)."""
    counts = labelled.select(F.posexplode("bins").alias("feature", "bin"), "good").groupBy("feature", "bin").agg(
        F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")
    ).collect()
    tables = [[(0.0, 0.0)] * BINS for _ in FEATURES]
    for row in counts:
        tables[row.feature][row.bin] = (float(row.good), float(row.bad))
    weights = []
    for bins in tables:
        good, bad = sum(g for g, _ in bins), sum(b for _, b in bins)
        if not good or not bad:
            weights.append([0.0] * BINS)
            continue
        total = good + bad
        prior = [prior_rows * (g + b + 1) / (total + BINS) for g, b in bins]
        weights.append([
            math.log((g + p) / (good + prior_rows)) - math.log((b + p) / (bad + prior_rows))
            for (g, b), p in zip(bins, prior, strict=True)
        ])
    return weights


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _logit(p: Column) -> Column:
    return F.log(p) - F.log(1 - p)


def _strength(groups: DataFrame, good: str, n: str, rate: Column | float) -> float:
    """Pseudo-rows of the beta prior whose variance the groups' rates show, by moments."""
    rate = F.lit(rate) if isinstance(rate, float) else rate
    seen = groups.filter(F.col(n) > 0).agg(
        F.sum(F.col(n) * F.pow(F.col(good) / F.col(n) - rate, 2)).alias("spread"),
        F.sum(rate * (1 - rate)).alias("noise"), F.sum(n).alias("n"),
        F.sum(F.pow(F.col(n), 2)).alias("n2"), F.sum(F.col(n) * rate * (1 - rate)).alias("level"),
    ).first()
    if not seen.n or not seen.level:
        return 1.0
    variance = (seen.spread - seen.noise) / max(seen.n - seen.n2 / seen.n, 1e-9)  # between groups
    level = seen.level / seen.n
    if variance <= level / 10_000:
        return 10_000.0
    return max(level / variance - 1, 1.0)


def classify(
    docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
    host_col: str = "source", path_col: str = "lang", label_col: str = "quality", prior_rows: float = 5.0,
    threshold: float = 0.5, most_labels: int = 200_000,
) -> DataFrame:
    """{doc: all columns but the text, digest, evidence, host_rate, path_rate, score, keep}, of row_digest(). learn: which rows of labels are learnt
    from (a condition on them). If there are more, the weights of the bins are fitted to about `most_labels` of
    them; hosts and paths count every label. score is the probability of label 1, and keep is score >= threshold."""
    used = labels.filter(learn) if learn is not None else labels
    known = used.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.avg(F.col(label_col).cast("double")).alias("_good"))
    known = stored(known, "quality-labels")
    body = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    host, path = F.col(f"`{host_col}`").cast("string"), F.col(f"`{path_col}`").cast("string")
    rows = packed(
        docs, text_col, F.col(f"`{id_col}`").alias("_id"), host.alias("host"), path.alias("path"), body.alias("_body"),
        row_digest(F.col(f"`{id_col}`"), body, host, path).alias("digest"),
    )
    # The only pass over texts: what follows joins rows without them.
    narrow = stored(with_bins(rows, F.col("_body")).drop("_body"), "quality-bins")
    narrow = stored(narrow.join(known, "_id", "left"), "quality-labelled")
    fits = F.col("_good").isNotNull() & sampled(F.col("_id"), known.count(), most_labels)
    weights = bin_weights(narrow.filter(fits).select("bins", F.col("_good").alias("good")), prior_rows)

    first = narrow.agg(F.sum("_good").alias("good"), F.count("_good").alias("n")).first()
    rate = ((first.good or 0.0) + 0.5) / (first.n + 1.0)
    terms = [F.get(F.array(*[F.lit(w) for w in weights[i]]), F.get("bins", F.lit(i))) for i in range(len(FEATURES))]
    judged = narrow.withColumn("evidence", sum(terms, F.lit(0.0)))
    judged = judged.withColumn("own", F.coalesce("_good", _sigmoid(F.col("evidence") + _logit(F.lit(rate)))))
    paths = judged.groupBy("host", "path").agg(F.sum("own").alias("path_good"), F.count(F.lit(1)).alias("path_n"))
    paths = stored(paths, "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("path_good").alias("host_good"), F.sum("path_n").alias("host_n"))
    over_hosts = _strength(hosts, "host_good", "host_n", rate)
    both = stored(paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"]), "quality-sites")
    shrunk = both.withColumn("level", (F.col("host_good") + over_hosts * rate) / (F.col("host_n") + over_hosts))
    over_paths = _strength(shrunk, "path_good", "path_n", F.col("level"))
    both = both.select(F.col("host").alias("h"), F.col("path").alias("p"), "path_good", "path_n", "host_good", "host_n")
    placed = judged.join(both, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    # A document's own share is taken out of its priors.
    host_rate = (F.col("host_good") - F.col("own") + over_hosts * rate) / (F.col("host_n") - 1 + over_hosts)
    placed = placed.withColumn("host_rate", F.least(F.greatest(host_rate, F.lit(1e-6)), F.lit(1 - 1e-6)))
    path_rate = (F.col("path_good") - F.col("own") + over_paths * F.col("host_rate")) / (F.col("path_n") - 1 + over_paths)
    placed = placed.withColumn("path_rate", F.least(F.greatest(path_rate, F.lit(1e-6)), F.lit(1 - 1e-6)))
    score = _sigmoid(F.col("evidence") + _logit(F.col("path_rate")))
    return unpacked(placed.select("doc", "digest", "evidence", "host_rate", "path_rate", score.alias("score"))).withColumn(
        "keep", F.col("score") >= threshold
    )


def row_digest(row_id: Column, body: Column, host: Column, path: Column) -> Column:
    """What tells a row's judgement apart from that of other rows with its id."""
    return F.xxhash64(row_id, body, host, path)


def kept(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    path_col: str = "lang", **options,
) -> DataFrame:
    """The rows of docs that classify() keeps. Texts move only if the rejected rows are too many to broadcast."""
    judged = classify(docs, labels, id_col=id_col, text_col=text_col, host_col=host_col, path_col=path_col, **options)
    gone = stored(judged.filter(~F.col("keep")).select("digest", F.col(f"doc.`{id_col}`").alias("gone")).distinct(), "quality-rejected")
    columns = [F.col(f"docs.`{c}`") for c in docs.columns]
    key = row_digest(
        F.col(f"docs.`{id_col}`"), F.coalesce(F.col(f"docs.`{text_col}`"), F.lit("")),
        F.col(f"docs.`{host_col}`").cast("string"), F.col(f"docs.`{path_col}`").cast("string"),
    )
    met = (key == F.col("gone.digest")) & F.col(f"docs.`{id_col}`").eqNullSafe(F.col("gone.gone"))
    return docs.alias("docs").join(gone.alias("gone"), met, "left_anti").select(*columns)


def learnt(id_col: str = "doc_id") -> Column:
    """Three quarters of the labels; the rest is held out to measure accuracy."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2


def query(spark, sf_dir: str) -> DataFrame:
    result = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learnt())
    return result.select("doc.doc_id", "evidence", "host_rate", "path_rate", "score", F.col("keep").cast("int").alias("keep"))
