"""Held-out accuracy of the classifiers, their parts against brute force, and odd rows."""

import random

import numpy as np
import pytest

from foliograph.llm import line_dedup, quality, toxicity
from foliograph.llm.common import F, table

SF = "/root/testdata/sf0.01"


def test_maximal_segments_are_those_of_the_definition():
    rng = random.Random(2)

    def brute(scores, low, high, out):
        best = None
        for a in range(low, high):
            total = 0.0
            for b in range(a, high):
                total += scores[b]
                if total > 1e-9 and (best is None or total > best[0] + 1e-9 or (abs(total - best[0]) <= 1e-9 and b - a < best[2] - best[1])):
                    best = (total, a, b)
        if best:
            out.append((best[1], best[2], round(best[0], 6)))
            brute(scores, low, best[1], out)
            brute(scores, best[2] + 1, high, out)
        return out

    for _ in range(200):
        n, base = rng.randint(1, 14), -rng.choice([0.31, 0.77, 1.53])
        at = sorted(rng.sample(range(n), rng.randint(0, n)))
        positive = [rng.choice([0.413, 1.101, 2.719]) + rng.random() / 50 for _ in at]
        scores = [base] * n
        for p, s in zip(at, positive, strict=True):
            scores[p] = s
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.maximal_segments(at, positive, base)]
        assert sorted(got) == sorted(brute(scores, 0, n, []))


def test_toxicity_held_out(spark):
    rows = toxicity.query(spark, SF).filter("held_out").join(table(spark, SF, "labels"), "doc_id").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    assert right >= 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_toxicity_odd_rows(spark):
    rng = random.Random(6)
    filler = lambda: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(60))
    rows = [(i, filler() + ("" if i % 6 else " utter scoundrel"), i % 6 == 0) for i in range(300)]
    labelled = spark.createDataFrame([(t, int(x)) for _, t, x in rows], "text string, toxic int")
    model = toxicity.learn(labelled)
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "utter scoundrel " * 4000, "a"), (3, "plain", "a"), (None, "scoundrel", "b")], "doc_id long, text string, score string")
    got = {(r.doc_id, r.own, r.n): r.score for r in toxicity.score(docs, model).select("doc.doc_id", F.col("doc.score").alias("own"), F.size("passages").alias("n"), "score").collect()}
    assert len(got) == 5 and got[1, "a", 0] == got[2, "a", 0]
    assert max(got, key=got.get)[0] == 3
    for one in (0, 1):
        flat = toxicity.learn(labelled.filter(F.col("toxic") == one))
        assert len({r.score for r in toxicity.score(docs, flat).collect()}) == 1
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert np.isfinite(toxicity.learn(labelled.limit(0)).curve[0])


def test_quality_held_out(spark):
    rows = quality.query(spark, SF).join(table(spark, SF, "labels"), "doc_id").filter(~quality.learnt()).collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.keep for r in good) / len(good) > 0.97 and sum(r.keep for r in bad) / len(bad) < 0.05


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 1), (1, 0), (2, None), (3, 7), (None, 1)]])
def test_quality_odd_rows(spark, labels):
    docs = spark.createDataFrame([(1, "Some words.", None, None, 1.0), (1, "Some words.", None, None, 1.0), (None, None, "h", "p", 2.0), (3, "x" * 50_000, "h", None, 3.0)],
                                 "doc_id long, text string, source string, lang string, score double")
    rows = quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert quality.classify(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


def test_quality_sites_count_all_labels(spark):
    rng = random.Random(3)
    rows = [(i, f"{i} same words", f"h{i % 5}", f"p{i % 3}", int(rng.random() < (i % 5) / 5)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, quality int")
    rates = []
    for most in (200_000, 40):
        judged = quality.classify(docs, docs.select("doc_id", "quality"), most_labels=most)
        rates.append({r.doc_id: (round(r.host_rate, 9), round(r.path_rate, 9)) for r in judged.select("doc.doc_id", "host_rate", "path_rate").collect()})
    assert rates[0] == rates[1]


def test_lines_odd_rows(spark):
    line = "A line of more than forty characters, with É and é in it"
    rows = [(i, f"{i}\n \t{line.replace('A', 'a')}\n\n{line}\r", "x") for i in range(4)]
    rows += [(3, f"{line}\nshort", "x"), (None, line, "x"), (9, None, "x"), (10, "", "x"), (11, "\n\n", "x"), (12, "short\n" * 300, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lines string")
    got = sorted((str(r.doc_id), r.lines, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.dedup_lines(docs).select("doc.doc_id", "doc.lines", "n_lines", "n_dropped", "kept").collect())
    want = [(str(i), "x", 4, 2 if i < 3 else 0, f"{i}\n" if i < 3 else t) for i, t, _ in rows[:4]]
    want += [("3", "x", 2, 0, rows[4][1]), ("None", "x", 1, 1, ""), ("9", "x", 1, 0, ""), ("10", "x", 1, 0, ""), ("11", "x", 3, 0, "\n\n"), ("12", "x", 301, 0, "short\n" * 300)]
    assert got == sorted(want)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    plan = line_dedup.query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
