"""Tree concatenation against the tokenizers library, in one process and on Spark."""

import hashlib
import random

import pytest

from foliograph.llm import bpe


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def hard_texts(seed: int) -> list[str]:
    rng = random.Random(seed)
    alphabets = ["ab", "abc 1'!s", " \n\t", "é日本ж", "aA1 .'", "the in er ", "'stre ", "  x", "<|endoftext|> a"]
    texts = ["", " ", "a", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "a" * 3000, "ab" * 2000, " " * 999 + "a", "'" * 700 + "s"]
    for alphabet in alphabets:
        for n in (2, 17, 60, 400):
            texts.append("".join(rng.choice(alphabet) for _ in range(n)))
    return texts


@pytest.mark.parametrize("seed", range(8))
def test_tree_matches_library(library, seed):
    c = bpe.codec(bpe.default_ranks())
    for text in hard_texts(seed):
        want = library.encode(text, add_special_tokens=False).ids
        for chunk in (1, 3, 16, 150):
            assert c.encode(text, chunk).tolist() == want, (text, chunk)
        assert c.text(want) == library.decode(want, skip_special_tokens=False)


def test_long_runs_are_joined_by_tokens(library, monkeypatch):
    c = bpe.codec(bpe.default_ranks())
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghij") for _ in range(3000))
    parts = [(x, bpe.np.array(c.ordinary(x), dtype="int32")) for x in bpe.cut(text, 100)]
    while len(parts) > 1:
        parts = [c.join(a, b, limit=64) for a, b in zip(parts[::2], parts[1::2], strict=True)]
    assert parts[0][1].tolist() == library.encode(text, add_special_tokens=False).ids


def test_documents(spark, library):
    texts = hard_texts(1) + [None, "x " * 900]
    rows = [(i, t, "ids") for i, t in enumerate(texts)] + [(0, texts[5], "ids"), (None, "y" * 500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(docs, chunk=64)).select("doc.doc_id", "doc.ids", bpe.F.col("ids").alias("tokens"), "decoded").collect()
    want = sorted(
        (str(i), str(extra), str(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t, extra in rows
    )
    assert sorted((str(r.doc_id), str(r.ids), str(r.tokens), r.decoded) for r in got) == want


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_digests(spark, library):
    docs = spark.createDataFrame([(1, "Hello there"), (2, None)], "doc_id long, text string")
    ids = library.encode("Hello there").ids
    assert {tuple(r) for r in bpe.digests(docs).collect()} == {
        (1, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(b"Hello there").hexdigest()),
        (2, 0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest()),
    }
