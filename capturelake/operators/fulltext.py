"""Full-text search: a postings table, and queries of words, phrases, prefixes, AND and OR."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a text that are indexed: its letters and digits, in lower case.
_TOKEN = r"(?U)[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _TOKEN), lambda t: t != "")


# ---- stemming: the published algorithm of Porter (1980)
_V = "aeiou"


def _is_consonant(w: str, i: int) -> bool:
    return w[i] not in _V and (w[i] != "y" or i == 0 or not _is_consonant(w, i - 1))


def _measure(stem: str) -> int:
    kinds = "".join("c" if _is_consonant(stem, i) else "v" for i in range(len(stem)))
    return len(re.findall("v+c+", kinds))


def _has_vowel(stem: str) -> bool:
    return any(not _is_consonant(stem, i) for i in range(len(stem)))


def _cvc(w: str) -> bool:
    return len(w) >= 3 and _is_consonant(w, len(w) - 1) and not _is_consonant(w, len(w) - 2) and _is_consonant(w, len(w) - 3) and w[-1] not in "wxy"


# Suffixes of steps 2, 3 and 4.
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def stem(w: str) -> str:
    """Porter stem of a lower-case word; words of one or two letters, and words with other letters than a to z, stay."""
    if len(w) <= 2 or not re.fullmatch("[a-z]+", w):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and _has_vowel(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _is_consonant(w, len(w) - 1) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for suffix, other in sorted(table, key=lambda p: -len(p[0])):
            if w.endswith(suffix):
                if _measure(w[: -len(suffix)]) > 0:
                    w = w[: -len(suffix)] + other
                break
    for suffix in sorted(_STEP4, key=lambda s: -len(s)):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.StringType())
def stem_udf(word: pd.Series) -> pd.Series:
    return word.map(lambda w: None if w is None else stem(w))


def postings(documents: DataFrame, *, doc: str = "doc_id", text: str = "text", stemmed: bool = True, cap: int | None = None) -> DataFrame:
    """(term, doc, position): one row per word. ``cap`` indexes the first characters only, as an archive's text field may.

    Stemming is done once per distinct word and joined back, so that Python sees the vocabulary, not the corpus.
    """
    body = F.substring(F.col(text), 1, cap) if cap else F.col(text)
    rows = documents.select(F.col(doc).alias("doc"), F.posexplode(tokens(body)).alias("position", "word"))
    if not stemmed:
        return rows.select(F.col("word").alias("term"), "doc", "position")
    vocabulary = rows.select("word").distinct().withColumn("term", stem_udf("word"))
    return rows.join(vocabulary, "word").select("term", "doc", "position")


def search_all(index: DataFrame, words: list[str], stemmed: bool = True) -> DataFrame:
    """Documents that hold all words."""
    wanted = sorted({stem(w.lower()) if stemmed else w.lower() for w in words})
    hits = index.filter(F.col("term").isin(wanted)).select("doc", "term").distinct()
    return hits.groupBy("doc").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(wanted)).select("doc")


def search_any(index: DataFrame, words: list[str], stemmed: bool = True) -> DataFrame:
    wanted = sorted({stem(w.lower()) if stemmed else w.lower() for w in words})
    return index.filter(F.col("term").isin(wanted)).select("doc").distinct()


def search_prefix(index: DataFrame, prefix: str) -> DataFrame:
    """Documents with a term that begins with the prefix; the test is pushed to the scan of a stored index."""
    return index.filter(F.col("term").startswith(prefix.lower())).select("doc").distinct()


def search_phrase(index: DataFrame, words: list[str], stemmed: bool = True) -> DataFrame:
    """Documents that hold the words one after another: each word's places, moved to where the phrase starts, must meet."""
    wanted = [stem(w.lower()) if stemmed else w.lower() for w in words]
    places = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(k).alias("k")) for k, w in enumerate(wanted)])
    hits = index.filter(F.col("term").isin(sorted(set(wanted)))).withColumn("p", F.explode(places)).filter(F.col("p.w") == F.col("term"))
    starts = hits.select("doc", (F.col("position") - F.col("p.k")).alias("start"), F.col("p.k").alias("k")).distinct()
    return starts.groupBy("doc", "start").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(wanted)).select("doc").distinct()


def search(index: DataFrame, query: str, stemmed: bool = True) -> DataFrame:
    """Documents of a query: words are joined by AND, unless OR stands between; ``"a phrase"`` and ``prefix*`` are terms too.

    NOT, NEAR, parentheses and column filters are refused with a ValueError.
    """
    parts = re.findall(r'"[^"]*"|\S+', query)
    if any(p in ("NOT", "NEAR") or p.startswith("NEAR(") or (not p.startswith('"') and re.search(r"[():^]", p)) for p in parts):
        raise ValueError(f"unsupported query: {query!r}")
    groups: list[list[str]] = [[]]
    for p in parts:
        if p == "OR":
            groups.append([])
        elif p != "AND":
            groups[-1].append(p)
    if not all(groups):
        raise ValueError(f"incomplete query: {query!r}")

    def term(p: str) -> DataFrame:
        if p.startswith('"'):
            return search_phrase(index, [w for w in re.split(r"[\W_]+", p) if w], stemmed)
        return search_prefix(index, p[:-1]) if p.endswith("*") else search_all(index, [w for w in re.split(r"[\W_]+", p) if w], stemmed)

    conjunctions = [reduce(lambda a, b: a.join(b, "doc", "left_semi"), [term(p) for p in g]) for g in groups]
    return reduce(DataFrame.union, conjunctions).distinct() if len(conjunctions) > 1 else conjunctions[0]


def snippet(text: Column, word: str, before: int = 25, words: int = 50) -> Column:
    """Up to ``words`` words of a text around the first that equals ``word``, which is set in ``<b>``; NULL if there is none."""
    parts = F.split(text, r"\s+")
    place = F.array_position(F.transform(parts, lambda w: F.regexp_replace(F.lower(w), r"(?U)[^\p{L}\p{N}]+", "")), word.lower())
    start = F.greatest(place - before, F.lit(1)).cast("int")
    shown = F.transform(F.slice(parts, start, words), lambda w, k: F.when(k + start == place, F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w))
    dots = lambda test: F.when(test, F.lit("...")).otherwise(F.lit(""))
    return F.when(place > 0, F.concat(dots(start > 1), F.array_join(shown, " "), dots(start + words <= F.size(parts))))
