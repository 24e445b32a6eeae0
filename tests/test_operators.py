"""Folds, resolution, calibration, dedup and chat against brute force and scenarios."""

import random

import pytest
from pyspark.sql import functions as F

from foliograph import constants as K
from foliograph.functions import rewrite
from foliograph.operators import calibrate, chat, dedup, files, folds, graph, lint, registry, resolve
from foliograph.operators.grouping import top_k
from foliograph.sources.store import SCHEMAS

ITEM = "source string, bucket string, pos long, name string, type string, description string"
PAGES = "subdir string, name string, content string"


def page(tag, description, sources="s1", dates="", name="X"):
    dated = f"source_dates: [{dates}]\n" if dates else ""
    return f"---\ntype: entity\ntags: [{tag}]\nsources: [{sources}]\n{dated}created: 2020-01-01\n---\n\n# {name}\n\n{description}\n\n## Mentioned In\n\n- [[{sources}]]\n"


def test_fold_equals_the_ordered_loop_even_for_a_hot_key(spark):
    rng = random.Random(9)
    names = ["Net", "Nets", "NET", "Net (a)", "Graph", "Graphs", "Graph (b c)"]
    items = []
    for pos in range(1500):
        hot = rng.random() < 0.4
        name = rng.choice(names[:4]) if hot else rng.choice(names) + f" {rng.randint(0, 60)}"
        items.append(("f", "entities", pos, name, rng.choice(["a", "b"]), "d" * rng.randint(0, 40)))
    got = {r.key: (r.pos, r.name, r.type, len(r.description)) for r in folds.fold_items(spark.createDataFrame(items, ITEM)).collect()}
    keys = {r.name: r.key for r in spark.createDataFrame([(n,) for n in {i[3] for i in items}], "name string").select("name", folds.dedup_key(F.col("name")).alias("key")).collect()}
    best = {}
    for _, _, pos, name, kind, text in items:
        k = keys[name]
        if k not in best:
            best[k] = [pos, name, kind, len(text)]
        elif len(text) > best[k][3]:
            best[k] = [best[k][0], best[k][1] if len(name) > len(best[k][1]) else name, kind, len(text)]
        elif len(name) < len(best[k][1]):
            best[k][1] = name
    assert got == {k: tuple(v) for k, v in best.items()}


def test_cross_bucket_routing(spark):
    data = [
        ("f", "entities", 1, "Cosine", "metric", "short"), ("f", "concepts", 2, "Cosine (sim)", "metric", "longer text"),
        ("f", "entities", 3, "Ann", "person", "who"), ("f", "concepts", 4, "Ann", "odd", "w"),
        ("f", "entities", 5, "Solo", "tool", "x"),
    ]
    got = {(r.bucket, r.name): (r.type, r.description) for r in folds.cross_bucket(folds.fold_items(spark.createDataFrame(data, ITEM))).collect()}
    assert got == {("concepts", "Cosine"): ("metric", "longer text"), ("entities", "Ann"): ("person", "who"), ("entities", "Solo"): ("tool", "x")}


def _resolve(spark, items, pages, entries=(), cache=(), judge=None, embed=None, threshold=None):
    df = spark.createDataFrame([(f"s{i}", i, *it) for i, it in enumerate(items)], "source string, pos long, subdir string, name string, type string, description string, source_date string")
    out = resolve.resolve(
        df, spark.createDataFrame(list(pages), PAGES), spark.createDataFrame(list(entries), SCHEMAS["entries"]),
        spark.createDataFrame(list(cache), SCHEMAS["judge_cache"]), judge,
        None if embed is None else spark.createDataFrame(list(embed), SCHEMAS["embed_cache"]), threshold,
    )
    return [r for r in out.orderBy("pos").collect()]


MID_OLD = "An encoder model pretrained by one research group"
MID_NEW = "An encoder model pretrained with masked tokens for many tasks"


def test_resolution_stages(spark):
    pages = [
        ("entities", "Kraken", page("animal", "A sea creature of northern legends")),
        ("entities", "Borealis", page("model", MID_OLD, dates="2001-02")),
        ("entities", "Blank", page("model", "")),
    ]
    items = [
        ("entities", "New Thing", "tool", "fresh", ""),
        ("entities", "", "tool", "x", ""),
        ("entities", "Kraken", "tool", "A browser benchmark suite", ""),
        ("entities", "kraken", "tool", "A sea creature of northern legends", ""),
        ("entities", "Borealis", "model", "Wholly unrelated sentence on tax law", ""),
        ("entities", "Borealis", "model", MID_NEW, ""),
        ("entities", "Blank", "model", "", ""),
        ("concepts", "Kraken", "method", "other kind", ""),
    ]
    got = [(r.action, r.stage, r.resolved_name) for r in _resolve(spark, items, pages)]
    assert got == [
        ("create", 1, "New Thing"), ("create", 1, "Untitled"), ("fork", 2, "Kraken (tool)"), ("merge", 3, "Kraken"),
        ("fork", 3, "Borealis (model)"), ("fork", 4, "Borealis (model)"), ("fork", 3, "Blank (model)"), ("create", 1, "Kraken"),
    ]


@pytest.mark.parametrize("verdict, action", [(True, "merge"), (False, "fork"), (None, "fork")])
def test_judge_decides_the_borderline(spark, verdict, action):
    asked = []

    def judge(pairs):
        asked.append(pairs.count())
        return pairs.select("key", F.lit(verdict).cast("boolean").alias("verdict"))

    items = [("entities", "Borealis", "model", MID_NEW, "")] * 3
    got = _resolve(spark, items, [("entities", "Borealis", page("model", MID_OLD))], judge=judge)
    assert {(r.action, r.stage) for r in got} == {(action, 4)} and asked == [1]


def test_embeddings_and_age_gap(spark):
    pages = [("entities", "Borealis", page("model", MID_OLD, dates="2001-02"))]
    keys = [r.k for r in spark.createDataFrame([(MID_OLD,), (MID_NEW,)], "t string").select(resolve.embed_key(F.col("t")).alias("k")).collect()]
    item = ("entities", "Borealis", "model", MID_NEW)
    near = [(keys[0], [1.0, 0.0]), (keys[1], [0.9, 0.1])]
    far = [(keys[0], [1.0, 0.0]), (keys[1], [0.1, 0.9])]
    assert [(r.action, r.stage) for r in _resolve(spark, [(*item, "2003")], pages, embed=near)] == [("merge", 5)]
    assert [(r.action, r.stage) for r in _resolve(spark, [(*item, "2003")], pages, embed=far)] == [("fork", 5)]
    gap = _resolve(spark, [(*item, "2024-01-01")], pages, embed=near)[0]
    assert (gap.action, gap.stage, gap.details["age_gap_years"]) == ("fork", 3, 23.0)
    assert _resolve(spark, [(*item, "2024-01-01")], pages)[0].reason != "age gap"


ENTRY = ("Aurora", "model", ["model", "tool"], "A curated description of the Aurora weather model", ["Aurora LM", "AL"], "entities", "seed", 0)


def test_alias_anchor(spark):
    pages = [("entities", "Aurora", page("model", "Something else entirely about lights"))]
    items = [
        ("entities", "aurora (model)", "tool", "thin", ""),
        ("entities", "AL", "", "A rich incoming description of more than thirty letters", ""),
        ("entities", "Aurora", "person", "A singer from the far north of the continent", ""),
        ("concepts", "Aurora", "model", "x", ""),
    ]
    got = _resolve(spark, items, pages, [ENTRY])
    assert [(r.action, r.stage, r.resolved_name) for r in got[:2]] == [("merge", 0, "Aurora"), ("merge", 0, "Aurora")]
    assert got[0].description == ENTRY[3] and got[0].type == "model"
    assert got[1].description.startswith("A rich incoming")
    assert got[2].stage == 2 and got[3].stage == 1
    absent = _resolve(spark, items[:1], [("entities", "Other", "x")], [ENTRY])
    assert (absent[0].action, absent[0].resolved_name) == ("create", "Aurora")


def test_alias_index_never_shadows_a_canonical_name(spark):
    entries = [
        ("Alpha", "tool", ["tool"], "", ["Beta", "Shared"], "entities", "seed", 0),
        ("Beta", "tool", ["tool"], "", ["Alpha", "Shared"], "entities", "promoted", 1),
    ]
    got = {r.key: r.primary_key for r in registry.alias_index(spark.createDataFrame(entries, SCHEMAS["entries"])).collect()}
    assert got == {"alpha": "alpha", "beta": "beta", "shared": "beta"}


def test_promotion_gates(spark):
    long = "A description that is certainly longer than thirty characters"
    pages = [
        ("entities", "Good (x)", page("tool", long, "a, b, c")), ("entities", "Few", page("tool", long, "a, b")),
        ("entities", "Thin", page("tool", "short", "a, b, c")), ("sources", "Src", page("tool", long, "a, b, c")),
        ("entities", "Aurora", page("tool", long, "a, b, c")),
    ]
    got = registry.promote(spark.createDataFrame(pages, PAGES), spark.createDataFrame([ENTRY], SCHEMAS["entries"])).collect()
    assert [(r.canonical_name, r.canonical_type) for r in got] == [("Good", "tool")]


def _brute_threshold(samples):
    pos = [c for c, s in samples if s]
    neg = [c for c, s in samples if not s]
    if len(samples) < 20 or len(pos) < 5 or len(neg) < 5:
        return 0.75
    best, score = 0.75, -1.0
    for t in sorted({c for c, _ in samples}):
        tp, fp = sum(c >= t for c in pos), sum(c >= t for c in neg)
        if tp:
            p, r = tp / (tp + fp), tp / len(pos)
            f1 = round(2 * p * r / (p + r), 12)
            if f1 > score:
                best, score = t, f1
    return best


def test_threshold_equals_brute_force(spark):
    rng = random.Random(6)
    for n in (10, 19, 20, 60, 400):
        samples = [(round(rng.uniform(-1, 1), 2), rng.random() < 0.4) for _ in range(n)]
        got = calibrate.tuned_threshold(spark.createDataFrame(samples, SCHEMAS["samples"])).first().threshold
        assert got == _brute_threshold(samples)
    skewed = [(0.9, True)] * 50 + [(0.1, False)]
    assert calibrate.tuned_threshold(spark.createDataFrame(skewed, SCHEMAS["samples"])).first().threshold == 0.75


def test_merge_plan_applied_once_leaves_nothing(spark):
    pages = [
        ("entities", "URL", page("tool", "short", "a")), ("entities", "URL (locator)", page("tool", "a longer text", "A, b", dates="2001")),
        ("concepts", "Cosine", page("metric", "x", "c")), ("entities", "Cosine", page("metric", "y y", "d")),
        ("sources", "S", "[[URL (locator)]] [[URL (locator)|kept]] [[Cosine]] [[[URL (locator)]]"),
    ]
    df = spark.createDataFrame(pages, PAGES)
    planned = dedup.plan(df)
    keep = {(r.subdir, r.name) for r in planned.filter("role = 'keep'").collect()}
    assert keep == {("entities", "URL"), ("concepts", "Cosine")}
    after = dedup.apply(df, planned)
    got = {(r.subdir, r.name): r.content for r in after.collect()}
    assert set(got) == {("entities", "URL"), ("concepts", "Cosine"), ("sources", "S")}
    assert got["sources", "S"] == "[[URL]] [[URL (locator)|kept]] [[Cosine]] [[[URL]]"
    assert "sources: [a, b]\nsource_dates: [2001]" in got["entities", "URL"] and "- [[b]]" in got["entities", "URL"]
    assert dedup.plan(spark.createDataFrame([(*k, v) for k, v in got.items()], PAGES)).count() == 0


def test_rename_is_simultaneous(spark, rows):
    renames = F.create_map(F.lit("A"), F.lit("B"), F.lit("B"), F.lit("C"))
    assert rows([("[[A]] [[B]] [[a]]",)], "c string", r=rewrite.rename_links(F.col("c"), renames)) == [("[[B]] [[C]] [[a]]",)]


def test_callout_is_idempotent(rows):
    text = page("tool", "text")
    once = rows([(text,)], "c string", r=rewrite.add_callout(F.col("c"), F.lit("Twin")))
    twice = rows(once, "c string", r=rewrite.add_callout(F.col("c"), F.lit("Twin")))
    assert once == twice and once[0][0].count("[[Twin]]") == 1 and once[0][0].index("# X") < once[0][0].index("[[Twin]]")


def test_history_equals_backward_loop_with_a_hot_conversation(spark):
    rng = random.Random(8)
    messages = [(1 if rng.random() < 0.5 else rng.randint(2, 6), i, rng.choice(["user", "assistant", "system"]), "m" * rng.randint(0, 50)) for i in range(600)]
    messages += [(7, 0, "user", "z" * 5000)]
    got = {}
    for r in chat.history_entries(spark.createDataFrame(messages, "conv_id int, turn int, role string, text string"), 300).collect():
        got.setdefault(r.conv_id, []).append((r.turn, r.entry))
    for conv in range(1, 8):
        budget, want = 300, []
        for _, turn, role, text in sorted((m for m in messages if m[0] == conv), key=lambda m: -m[1]):
            limit = 4000 if role == "user" else 2000
            entry = ("User: " if role == "user" else "Assistant: ") + (text[:limit] + "…" if len(text) > limit else text)
            if len(entry) > budget:
                if not want:
                    want.append((turn, entry[:budget]))
                break
            budget -= len(entry)
            want.append((turn, entry))
        assert sorted(got.get(conv, [])) == sorted(want)


def test_salted_top_k_is_exact(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 5).alias("g"), F.xxhash64("id").alias("v"))
    got = {(r.g, r.v, r["rank"]) for r in top_k(df, ["g"], [F.col("v")], 1500, salts=8).collect()}
    rows_ = [(r.g, r.v) for r in df.collect()]
    want = set()
    for g in {g for g, _ in rows_}:
        want |= {(g, v, i) for i, v in enumerate(sorted(v for gg, v in rows_ if gg == g)[:1500], 1)}
    assert got == want


def test_lint_scenarios(spark):
    pages = spark.createDataFrame([
        ("entities", "A", page("tool", "links [[b]] and [[gone]]", "A", name="A")), ("entities", "B", page("tool", "x" * 90, "B", name="B")),
        ("entities", "Bare", "no front matter"), ("entities", "Open", "---\ntype: x"), ("concepts", "Empty", page("t", "", "z", name="Empty")),
    ], PAGES)
    catalog = spark.createDataFrame([("## Entities", "- [[a]] — x"), ("## Entities", "- [[B|alias]] [[lost]]")], "section string, line string")
    got = {(r.code, r.page, r.target) for r in lint.report(pages, catalog).collect()}
    assert ("broken_link", "A", "gone") in got and ("stale_index", "index", "lost") in got
    assert ("not_in_index", "B", "") in got and ("not_in_index", "A", "") not in got
    assert ("orphan", "Bare", "") in got and ("orphan", "A", "") not in got
    assert ("isolated", "Bare", "") in got and ("bodyless", "Empty", "") in got
    problems = {r.page: r.detail for r in lint.report(pages, catalog).filter("code = 'frontmatter'").collect()}
    assert problems == {"Bare": "missing yaml frontmatter", "Open": "unclosed yaml frontmatter"}


def test_upload_gate(spark):
    data = [("../x/a.MD", 10), (".env", 1), ("b.exe", 1), ("", 1), ("big.pdf", K.MAX_UPLOAD_BYTES + 1)]
    got = [(r.stored_as, r.accepted) for r in files.upload_gate(spark.createDataFrame(data, "filename string, size_bytes long")).collect()]
    assert got == [("a.MD", True), (None, False), (None, False), (None, False), ("big.pdf", False)]


def test_unique_pages_last_kind_wins(spark):
    df = spark.createDataFrame([("sources", "A", "1"), ("synthesis", "A", "2"), ("entities", "B", "3")], PAGES)
    assert {tuple(r) for r in graph.unique_pages(df).collect()} == {("synthesis", "A", "2"), ("entities", "B", "3")}
