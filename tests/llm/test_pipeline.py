"""The pipeline against the same steps in Python, on a small corpus."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from foliograph.llm import bpe, quality
from foliograph.llm.common import F
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_jaccard import brute as brute_components

PARTS = ["lo", "ra", "mi", "ten", "qua", "sol", "ver", "is", "on", "dur"]


def prose(rng, n):
    words = ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w.capitalize() + "." if i % 9 == 0 else w for i, w in enumerate(words))


def junk(rng, n):
    return " ".join(rng.choice(PARTS).upper() + "!!" for _ in range(n))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(9)
    shared = "This line stands in many documents, always with the same words"
    texts = [prose(rng, rng.randint(30, 160)) for _ in range(60)]
    for i in range(0, 24, 3):
        texts[i] += "\n" + shared + "\n" + prose(rng, 12)
    texts += [junk(rng, rng.randint(40, 90)) for _ in range(30)]
    texts += [texts[40], texts[41] + " tail", texts[42].replace(".", "", 1)]
    items = [" ".join(texts[50].split()[5:30]), prose(rng, 20), "", None]
    texts += [prose(rng, 40) + " " + items[1] + " " + prose(rng, 30), "", None]
    folder = tmp_path_factory.mktemp("pipeline")
    rows = {
        "doc_id": list(range(len(texts))), "text": texts, "lang": ["en"] * len(texts),
        "source": [f"src{i % 4}" if i % 7 else None for i in range(len(texts))], "n_chars": [len(t or "") for t in texts],
    }
    pq.write_table(pa.table(rows), folder / "documents.parquet")
    labelled = [i for i in range(len(texts)) if i % 2]
    good = [0 if "!!" in (texts[i] or "") else 1 for i in labelled]
    pq.write_table(pa.table({"doc_id": labelled, "quality": pa.array(good, pa.int32()), "toxic": pa.array([0] * len(good), pa.int32())}), folder / "labels.parquet")
    pq.write_table(pa.table({"item_id": list(range(len(items))), "text": items}), folder / "benchmark.parquet")
    return str(folder), texts, items


def test_against_python(spark, folder):
    path, texts, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {r.doc_id: r.keep for r in quality.classify(docs, spark.read.parquet(f"{path}/labels.parquet")).select("doc.doc_id", "keep").collect()}
    assert all(kept[i] == ("!!" not in (t or "")) for i, t in enumerate(texts) if t)
    state = [(i, texts[i] or "") for i in range(len(texts)) if kept[i]]

    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in state:
        for k in {key(x) for x in t.split("\n")}:
            held.setdefault(k, []).append(i)
    frequent = {k: max(v) for k, v in held.items() if len(v) >= 5 and len(k) >= 40}
    assert frequent
    state = [(i, "\n".join(x for x in t.split("\n") if frequent.get(key(x), i) == i)) for i, t in state]
    components = {int(i): int(c) for i, _, c in brute_components(state)}
    assert any(i != c for i, c in components.items())
    state = [(i, t) for i, t in state if components[i] == i]
    hits = {int(i): bad for i, _, _, _, bad in brute_hits(state, list(enumerate(items)), 13)}
    assert any(hits.values())
    state = [(i, t) for i, t in state if not hits[i]]

    c = bpe.codec(bpe.default_ranks())
    got = corpus_pipeline.run(spark, path)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == sorted((i, len(c.encode(t))) for i, t in state)


def test_stages_keep_columns_and_odd_rows(spark, folder):
    path, texts, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    odd = docs.limit(3).union(docs.limit(3)).union(
        spark.createDataFrame([(None, None, None, None, None), (None, "Text here", None, None, 9)], docs.schema)
    )
    for rows in (odd, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            result = stage(spark, rows, path)
            assert result.columns == docs.columns
            result.collect()
        assert corpus_pipeline.tokens(spark, rows, path).count() == rows.count()


def test_rows_of_one_id_are_documents(spark):
    rng = random.Random(4)
    a, b, c = prose(rng, 60), prose(rng, 60), prose(rng, 60)
    rows = [(5, a), (5, b), (5, b), (7, a), (3, c), (3, None), (3, None), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", {"k": "v"}) for i, t in rows], "doc_id long, text string, lang string, source string, row map<string,string>")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id", "text").collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(5, a), (5, b), (3, c), (3, None), (3, None), (None, a), (None, a)]))


def test_rows_of_one_id_are_judged_apart(spark, folder):
    path, texts, _ = folder
    bad = next(t for t in texts if t and "!!" in t)
    docs = spark.createDataFrame([(9001, texts[0], "en", "src1", 1), (9001, bad, "en", "src1", 1), (None, texts[1], None, None, 1), (None, bad, None, None, 1)],
                                 spark.read.parquet(f"{path}/documents.parquet").schema)
    more = spark.read.parquet(f"{path}/documents.parquet").union(docs)
    got = [r.text for r in corpus_pipeline.quality(spark, more, path).filter("doc_id IS NULL OR doc_id = 9001").collect()]
    assert sorted(got) == sorted([texts[0], texts[1]])
