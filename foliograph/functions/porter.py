"""Accent folding and Porter stemming (Porter, 1980) as Column expressions.

The rules run over distinct words only: words are joined to their stems. A word travels with its
shape, the string of its vowels (v) and consonants (c); both are cut at the same places, so every
condition of the rules is one on the shape. The published steps are columns that follow one another.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.session import persist_durably

# --- fixed values: suffix tables of the published algorithm ---
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
    "logi": "log",
}
STEP3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)



@lru_cache(maxsize=1)
def accents() -> tuple[str, str]:
    """Letters with marks, and in the same places the letters without them."""
    found = []
    for code in range(0xC0, 0x3000):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            found.append((chr(code), plain))
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def folded(word: Column) -> Column:
    """The word without the marks on its letters."""
    return F.translate(word, *accents())


def shape(word: Column) -> Column:
    """A v or c for every letter; y is a vowel after a consonant."""

    def longer(done: Column, letter: Column) -> Column:
        vowel = letter.isin(*"aeiou") | ((letter == "y") & F.endswith(done, F.lit("c")))
        return F.concat(done, F.when(vowel, "v").otherwise("c"))

    return F.aggregate(F.split(word, ""), F.lit(""), longer)


def _cut(c: Column, n: int) -> Column:
    return F.left(c, F.length(c) - n)


def _measure(shape: Column) -> Column:
    return F.regexp_count(shape, F.lit("vc"))


def _short(word: Column, shape: Column) -> Column:
    """Whether the word ends consonant, vowel, consonant, the last of them not w, x or y."""
    return F.endswith(shape, F.lit("cvc")) & ~F.right(word, F.lit(1)).isin("w", "x", "y")


def _first(rules: Iterable[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first condition that holds."""
    rules = list(rules)
    start = F.when(*rules[0])
    return reduce(lambda chain, rule: chain.when(*rule), rules[1:], start).otherwise(otherwise)


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _changed(df: DataFrame, rules: list[tuple[Column, int, str]]) -> DataFrame:
    """The first rule (condition, letters to cut, letters to append) that holds, applied to word and shape."""
    cut = _first([(c, F.lit(n)) for c, n, _ in rules], F.lit(0))
    new = _first([(c, F.lit(a)) for c, _, a in rules], F.lit(""))
    shapes = "".join("v" if c in "aeiou" else "c" for c in _LETTERS)
    steps = df.withColumns({"_n": cut, "_new": new})
    return steps.withColumns({
        "_w": F.concat(F.left("_w", F.length("_w") - F.col("_n")), F.col("_new")),
        "_s": F.concat(F.left("_s", F.length("_s") - F.col("_n")), F.translate("_new", _LETTERS, shapes)),
    })


def _suffixes(table: dict[str, str], fits) -> list[tuple[Column, int, str]]:
    """The longest suffix of a table decides alone: it is replaced where fits(suffix)."""
    rules = []
    for suffix in sorted(table, key=len, reverse=True):
        ends = F.endswith("_w", F.lit(suffix))
        rules += [(ends & fits(suffix), len(suffix), table[suffix]), (ends, 0, "")]
    return rules


def stem_columns(df: DataFrame, word: str, out: str) -> DataFrame:
    """df with `out`: the stem of the accent-folded words of a column; very short and long ones stay as they are.

    No condition on the result may follow in the same plan: Spark would move it down and repeat every step in it."""
    w, s = F.col("_w"), F.col("_s")
    ends = lambda suffix: F.endswith(w, F.lit(suffix))
    vowel_before = lambda n: F.contains(_cut(s, n), F.lit("v"))
    measure_before = lambda n: _measure(_cut(s, n))
    last = F.right(w, F.lit(1))
    steps = df.withColumn("_fold", folded(F.col(word)))
    steps = steps.withColumns({"_w": F.col("_fold"), "_s": shape(F.col("_fold"))})
    steps = _changed(steps, [
        ((ends("sses") & (F.length(w) > 4)) | (ends("ies") & (F.length(w) > 3)), 2, ""), (ends("s") & ~ends("ss"), 1, ""),
    ])
    eed = ends("eed") & (F.length(w) > 3)
    steps = steps.withColumn("_bare", ~eed & ((ends("ed") & vowel_before(2)) | (ends("ing") & vowel_before(3))))
    steps = _changed(steps, [
        (eed & (measure_before(3) > 0), 1, ""), (F.col("_bare") & ends("ed"), 2, ""), (F.col("_bare") & ends("ing"), 3, ""),
    ])
    doubled = (F.length(w) > 1) & (last == F.substring(w, -2, 1)) & ~last.isin(*"aeioulsz")
    bare = F.col("_bare")
    steps = _changed(steps, [
        (bare & (ends("at") | ends("bl") | ends("iz")), 0, "e"), (bare & doubled, 1, ""), (bare & (_measure(s) == 1) & _short(w, s), 0, "e"),
    ])
    steps = _changed(steps, [(ends("y") & vowel_before(1), 1, "i")])
    for table in (STEP2, STEP3):
        steps = _changed(steps, _suffixes(table, lambda suffix: measure_before(len(suffix)) > 0))
    before_ion = F.endswith(_cut(w, 3), F.lit("s")) | F.endswith(_cut(w, 3), F.lit("t"))
    steps = _changed(steps, _suffixes(
        dict.fromkeys(STEP4, ""), lambda suffix: (measure_before(len(suffix)) > 1) & (before_ion if suffix == "ion" else F.lit(True))
    ))
    short_before = _short(_cut(w, 1), _cut(s, 1))
    steps = _changed(steps, [(ends("e") & ((measure_before(1) > 1) | ((measure_before(1) == 1) & ~short_before)), 1, "")])
    steps = _changed(steps, [(ends("ll") & (_measure(s) > 1), 1, "")])
    kept = F.octet_length("_fold").between(3, 64)
    return steps.withColumn(out, F.when(kept, w).otherwise(F.col("_fold"))).drop("_w", "_s", "_n", "_new", "_bare", "_fold")


def stems(words: DataFrame) -> DataFrame:
    """Stored (word, stem) of the distinct words of a relation (word)."""
    return persist_durably(stem_columns(words.select("word").distinct(), "word", "stem"), "stems")
