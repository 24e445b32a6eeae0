"""Attribution against character-by-character counts over the library's offsets."""

import pytest

from foliograph.llm import token_counts
from foliograph.llm.common import F


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


TEXTS = ["", None, "\n", "one line", "a\n\nb\n", "ñandú日本\nжук 'tis\n\n\n  end  ", "tab\t\n x" * 40, "\n\n\n\n", "z" * 5000]


def brute(library, text, spans, rule):
    want = [0.0] * len(spans)
    outside = 0.0
    for a, b in library.encode(text, add_special_tokens=False).offsets:
        places = {"start": [a], "end": [b - 1], "share": list(range(a, b))}[rule]
        for place in places:
            part = [p for p, (s, e) in enumerate(spans) if s <= place < e]
            if part:
                want[part[0]] += 1 / len(places)
            else:
                outside += 1 / len(places)
    return want, outside


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_lines(spark, library, rule):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, part string")
    got = {}
    for r in token_counts.count_tokens(docs, rule=rule).select("doc.doc_id", F.col("doc.part").alias("own"), "part", "n_tokens").collect():
        assert r.own == "x"
        got.setdefault(r.doc_id, {})[r.part] = r.n_tokens
    for i, text in enumerate(TEXTS):
        text = text or ""
        spans = [tuple(map(int, s)) for s in token_counts.line_spans(text)]
        want, outside = brute(library, text, spans, rule)
        assert not outside
        assert [got[i][p] for p in range(len(spans))] == pytest.approx(want), text


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_given_spans(spark, library, rule):
    text, spans = "Hello there, general reader of words", [(2, 4), (4, 4), (7, 13), (13, 30)]
    docs = spark.createDataFrame([(1, text, spans), (1, text, spans), (2, None, None), (3, "ab", [])],
                                 "doc_id long, text string, spans array<struct<start:int,end:int>>")
    rows = token_counts.count_tokens(docs, spans_col="spans", rule=rule).select("doc.*", "*").collect()
    want, outside = brute(library, text, spans, rule)
    found = [r for r in rows if r.doc_id == 1]
    assert len(found) == 2 * (len(spans) + 1)
    for p, n in [*enumerate(want), (-1, outside)]:
        assert [r.n_tokens for r in found if r.part == p] == pytest.approx([n, n])
    assert [(r.part, r.n_tokens) for r in rows if r.doc_id == 2] == [(0, 0.0)]
    assert [(r.part, r.n_tokens) for r in rows if r.doc_id == 3] == [(-1, 1.0)]


def test_empty_table(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0
