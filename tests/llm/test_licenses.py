"""Token automata against the same templates as regular expressions over words."""

import random
import re

import pytest

from foliograph.llm import licenses as ls
from foliograph.llm.licenses import Template


def as_pattern(items, outer=True):
    parts = []
    for item in items:
        if isinstance(item, str):
            parts.append(re.escape(item) + " ")
        elif isinstance(item, int):
            parts.append(r"(?:\S+ ){0,%d}" % item)
        else:
            parts.append("(?:" + as_pattern(item, False) + ")?")
    return "".join(parts)


def brute(templates, words):
    """(template, first, last): at each start the longest match, leftmost ones kept."""
    found = []
    for t, template in enumerate(templates):
        pattern, free = re.compile(as_pattern(ls.parsed(template.wording))), 0
        for i in range(len(words)):
            ends = [j for j in range(i + 1, len(words) + 1) if i >= free and pattern.fullmatch(" ".join(words[i:j]) + " ")]
            if ends:
                found.append((t, i, max(ends) - 1))
                free = max(ends)
    return sorted(found, key=lambda m: (m[1], m[0]))


SMALL = (
    Template("a", "one <<beginOptional>>two <<beginOptional>>three<<endOptional>><<endOptional>> four"),
    Template("b", "one <<var;name=x;max=3>> four <<var;max=2>> one"),
    Template("c", "<<beginOptional>>two<<endOptional>> one one"),
    Template("m", "four one", "mention"),
    Template("a", "two <<var;name=x;original=a b;match=.+;max=1>>", "mention"),
)


@pytest.mark.parametrize("seed", range(30))
def test_small_templates(seed):
    rng = random.Random(seed)
    words = [rng.choice(["one", "two", "three", "four", "x"]) for _ in range(rng.randrange(0, 40))]
    matcher = ls.Automaton(SMALL)
    numbers = ls.np.array([matcher.numbers.get(w, 0) for w in words], dtype="int32")
    got, _ = matcher.matches(numbers)
    assert got == brute(SMALL, words)


def test_states_are_rebuilt(monkeypatch):
    monkeypatch.setattr(ls, "STATES", 2)
    matcher = ls.Automaton(SMALL)
    words = "one two three four x one a b four one one two".split() * 3
    got, _ = matcher.matches(ls.np.array([matcher.numbers.get(w, 0) for w in words], dtype="int32"))
    assert got == brute(SMALL, words)


def test_markup():
    assert ls.parsed("A-b <<beginOptional>>c<<endOptional>><<var;name=n>>") == ["a", "b", ["c"], ls.VAR_WORDS]
    for bad in ("<<endOptional>> a", "<<beginOptional>> a", "a <<what>>", "<<beginOptional>>a<<endOptional>>"):
        with pytest.raises(ValueError):
            ls.parsed(bad)


def plain(template):
    """The wording with all optional parts and some replaced words."""
    return re.sub(r"<<var.*?>>", "Some Holder, Inc.", re.sub(r"<<(begin|end)Optional>>", "", template.wording))


def short(template):
    """The wording without optional parts and replaced words."""
    flat = lambda items: [w for w in items if isinstance(w, str)]
    return " ".join(flat(ls.parsed(template.wording)))


def test_every_template_is_found_in_itself():
    matcher = ls.automaton(ls.TEMPLATES)
    for t, template in enumerate(ls.TEMPLATES):
        for text in (plain(template), short(template), "x\n" + plain(template).upper() + " y"):
            found, score = matcher.matches(matcher.word_numbers(text))
            assert t in {m[0] for m in found}, template
            assert score == (0.5 if template.kind == "mention" and len({m[0] for m in found} - {0, 1, 2, 3}) == 0 else 1.0)


def test_mandatory_words_must_match():
    matcher = ls.automaton(ls.TEMPLATES)
    mit = plain(ls.NOTICES[0])
    assert matcher.matches(matcher.word_numbers(mit))[1] == 1.0
    found, score = matcher.matches(matcher.word_numbers(mit.replace("noninfringement", "x").replace("NONINFRINGEMENT", "x")))
    assert found == [] and 0.3 < score < 0.5
    assert matcher.matches(matcher.word_numbers(mit.replace("IN NO EVENT SHALL", "in no event shall " + "w " * 21)))[0] == []


def base_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    places = sorted(
        (i, label) for phrase, label in phrases.items() for i in range(len(words))
        if words[i:i + len(phrase.split())] == phrase.split()
    )
    labels = ",".join(sorted({label for _, label in places}))
    return (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, labels)


TEXTS = [
    None, "", "  ", "Licensed under CC BY-NC 4.0.", "cc by cc by CC-BY", "Released under the MIT License.\nMIT license",
    "This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL  public-license!",
    "mit Lizenz, Apache; License é", "Licensed under the Apache License, Version 2.0.", "apache\x00license\x7fmit_license MITlicense", "a " * 300_000 + "mit license",
]


def test_documents(spark, tmp_path):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None), (None, TEXTS[4], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, matches string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in ls.query(spark, str(tmp_path)).collect()]
    assert sorted(map(str, (r[:6] for r in got))) == sorted(str((i, *base_of(t))) for i, t, _ in rows)
    by_id = {r[0]: r for r in got}
    assert [by_id[i][6] for i in (3, 4, 5, 6, 9)] == ["cc-by,cc-by-nc-4.0", "cc-by", "mit", "gpl,gpl-3.0", "apache,apache-2.0"]
    assert [by_id[i][7] for i in (0, 1, 3, 4, 5, 8)] == [0.0, 0.0, 1.0, 0.5, 1.0, 0.5]
    assert all(set(r[5].split(",")) <= set(r[6].split(",")) or not r[5] for r in got)
    odd = ls.scan(docs.withColumnsRenamed({"matches": "row", "doc_id": "_"})).select("doc._", "doc.row").collect()
    assert sorted(map(str, (tuple(r) for r in odd))) == sorted(str((i, x)) for i, _, x in rows)


def test_empty(spark):
    assert ls.scan(spark.createDataFrame([], "text string")).collect() == []
