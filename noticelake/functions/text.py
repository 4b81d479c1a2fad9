"""Tokens, stems, weighted texts and full-text conditions."""

from __future__ import annotations

import functools
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.storage import ship

# English function words left out of searches and features.
ENGLISH = frozenset((
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "because", "been",
    "before", "being", "between", "both", "but", "by", "can", "could", "did", "do", "does", "for", "from", "had",
    "has", "have", "he", "her", "here", "him", "his", "how", "i", "if", "in", "into", "is", "it",
    "its", "just", "may", "me", "might", "more", "most", "must", "my", "no", "nor", "not", "of", "off",
    "on", "once", "only", "or", "other", "our", "out", "over", "own", "same", "she", "should", "so", "some",
    "such", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "through", "to",
    "too", "under", "until", "up", "very", "was", "we", "were", "what", "when", "where", "which", "while", "who",
    "whom", "why", "will", "with", "would", "you", "your",
))
#: Words that every notice has.
DOMAIN = frozenset((
    "product", "products", "recall", "recalled", "recalls", "food", "foods", "may", "contain", "contains", "due", "possible", "potential", "presence", "undeclared", "found", "label", "labels",
))


def tokens(c: Column, least: int = 2) -> Column:
    """Runs of letters of a text in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(rf"\b[a-z]{{{least},}}\b"), F.lit(0))


def bigrams(t: Column) -> Column:
    return F.zip_with(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def singular(c: Column) -> Column:
    """A word of four letters or more without its plural s."""
    return F.when((F.length(c) >= 4) & c.endswith("s") & ~c.endswith("ss"), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)


def strip_company(text: Column, company: Column) -> Column:
    """A text without the words, of three letters or more, of the company's name."""
    own = F.filter(F.split(F.lower(F.coalesce(company, F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) > 2)
    return F.array_join(F.filter(F.split(text, r"\s+"), lambda w: ~F.array_contains(own, F.regexp_replace(F.lower(w), "[^a-z0-9]+", ""))), " ")


def compose_text(reason: Column, product: Column, company: Column, reason_weight: int = 2, product_weight: int = 1) -> Column:
    """Reason and product, without the company, as often as they weigh."""
    part = lambda c, n: F.array_join(F.array_repeat(strip_company(F.coalesce(c, F.lit("")), company), n), " ")
    return F.trim(F.concat_ws(" ", part(reason, reason_weight), part(product, product_weight)))


def _shape(word: str) -> str:
    """Consonants as c, vowels as v; y is a vowel after a consonant."""
    out = ""
    for i, x in enumerate(word):
        out += "v" if x in "aeiou" or (x == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _ends_cvc(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _ends_double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


# The suffixes of Porter's steps 2, 3 and 4 (An algorithm for suffix stripping, 1980).
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(word: str, suffixes) -> str | None:
    return max((x for x in suffixes if word.endswith(x)), key=len, default=None)


@functools.lru_cache(1 << 16)
def stem(word: str) -> str:
    """Porter's stem of a lower-case word."""
    if len(word) < 3:
        return word
    end = _longest(word, {"sses": 2, "ies": 2, "ss": 0, "s": 1})
    if end:
        word = word[: len(word) - {"sses": 2, "ies": 2, "ss": 0, "s": 1}[end]]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif (end := _longest(word, ("ed", "ing"))) and "v" in _shape(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _ends_double(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _ends_cvc(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        if (end := _longest(word, table)) and _measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + table[end]
    if end := _longest(word, _STEP4):
        rest = word[: -len(end)]
        if _measure(rest) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
            word = rest
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _ends_cvc(rest)):
            word = rest
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def stemmed(c: Column) -> Column:
    """The stems of an array of words, function words left out. A batch's distinct words are stemmed once each."""
    if spark := SparkSession.getActiveSession():
        ship(spark)
    kept = F.filter(c, lambda w: ~w.isin(*sorted(ENGLISH)))

    @F.arrow_udf("array<string>")
    def stems(words: pa.Array) -> pa.Array:
        coded = words.flatten().dictionary_encode()
        flat = pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
        ends = np.cumsum([0, *(0 if n is None else n for n in words.value_lengths().to_pylist())])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=words.is_null() if words.null_count else None)

    return stems(kept)


def with_terms(df: DataFrame, text: str = "search_text", out: str = "terms") -> DataFrame:
    """Adds the stemmed words of a text in order, what a full-text index would hold."""
    return df.withColumn(out, stemmed(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))))


def _query_terms(part: str) -> list[str]:
    return [stem(w) for w in re.findall("[a-z0-9]+", part.lower()) if w not in ENGLISH]


def parse_query(query: str, terms: Column) -> tuple[Column, list[str]]:
    """The condition of a web-style query over a term array, and its positive terms.

    Words are all required, quoted words next to each other; ``or`` joins its neighbours, a minus
    excludes. Anything else is ignored; a query without words meets nothing.
    """
    groups: list[list[tuple[bool, list[str]]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if word.lower() == "or":
            groups.append([])
            continue
        if found := _query_terms(phrase or word):
            groups[-1].append((minus == "-", found))
    joined = F.concat(F.lit(" "), F.array_join(terms, " "), F.lit(" "))
    anything, wanted = F.lit(False), []
    for group in groups:
        if not group:
            continue
        met = F.lit(True)
        for excluded, found in group:
            has = joined.contains(" " + " ".join(found) + " ")
            met &= ~has if excluded else has
            wanted += [] if excluded else found
        anything |= met
    return F.coalesce(anything, F.lit(False)), wanted


def relevance(terms: Column, wanted: list[str], saturation: float = 1.2) -> Column:
    """How often the wanted terms occur, each with falling returns, dampened by the text's length."""
    if not wanted:
        return F.lit(0.0)
    size = F.size(terms)
    count = lambda w: F.size(F.filter(terms, lambda t: t == w)).cast("double")
    hits = [count(w) for w in dict.fromkeys(wanted)]
    gain = reduce(lambda a, b: a + b, [h / (h + saturation) for h in hits])
    return F.when(size > 0, gain / (1 + F.log1p(size))).otherwise(0.0)
