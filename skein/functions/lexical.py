"""Full-text matching: tokens, stems, web-style queries and cover-density ranks."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.stems import CHANGED, stem_of, stemmed

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def stop_words(language: str) -> list[str]:
    return StopWordsRemover.loadDefaultStopWords(language)


def tokens(text: Column, language: str | None = None) -> Column:
    """Lower-cased runs of letters and digits; with a language, stems without stop words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_SPLIT), lambda t: t != "")
    if language is None:
        return words
    return F.transform(F.filter(words, lambda t: ~t.isin(*stop_words(language))), lambda t: stemmed(t, language))


def websearch(query: str, language: str | None = None) -> list[list[tuple[bool, list[str]]]]:
    """A web-style query as alternatives of conjunctions of (negated, phrase). Bare words and "phrases" are joined by
    and, OR separates alternatives of its neighbours, - negates."""
    groups: list[list[tuple[bool, list[str]]]] = []
    either = False
    stops = set(stop_words(language)) if language else set()
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query):
        if not phrase and word.upper() == "OR" and not minus:
            either = bool(groups)
            continue
        terms = [t for t in re.findall(r"[^\W_]+", (phrase or word).lower()) if t not in stops]
        terms = [stem_of(t, language) for t in terms] if language else terms
        if not terms:
            continue
        if either:
            groups[-1].append((bool(minus), terms))
        else:
            groups.append([(bool(minus), terms)])
        either = False
    return groups


def _holds(words: Column, terms: list[str]) -> Column:
    if len(terms) == 1:
        return F.array_contains(words, terms[0])
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).contains(f" {' '.join(terms)} ")


def matches(words: Column, query: str, language: str | None = None) -> Column:
    """Whether a token array fits a web-style query; an empty query fits nothing."""
    groups = websearch(query, language)
    if not groups:
        return F.lit(False)
    return reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, (~_holds(words, t) if neg else _holds(words, t) for neg, t in group)) for group in groups))


def may_match(text: Column, query: str, language: str | None = None) -> Column:
    """A cheap condition that every text which fits the query meets: it holds the words somewhere."""
    low = F.lower(text)
    # a stem's last letters may differ from the word's
    part = lambda t: t if language is None else t[: max(1, len(t) - CHANGED[language])]
    needed = [group for group in websearch(query, language) if not any(neg for neg, _ in group)]
    return reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (low.contains(part(t)) for t in terms)) for _, terms in group)) for group in needed), F.lit(True))


def cover_density(positions: list[list[int]]) -> float:
    """Sum over minimal covers (runs that hold every term) of terms / length, after Clarke, Cormack and Tudhope."""
    if not positions or not all(positions):
        return 0.0
    events = sorted((p, k) for k, ps in enumerate(positions) for p in ps)
    last: dict[int, int] = {}
    total, begun = 0.0, -1
    for p, k in events:
        last[k] = p
        if len(last) == len(positions) and (begin := min(last.values())) > begun:
            total += len(positions) / (p - begin + 1)
            begun = begin
    return total


def cover_terms(query: str, language: str | None = None) -> list[list[str]]:
    """The terms that a cover must hold, each with its alternatives: each word of a phrase is a term, and of alternatives
    any is."""
    terms: list[list[str]] = []
    for group in websearch(query, language):
        told = [words_ for neg, words_ in group if not neg]
        if len(told) == 1:
            terms += [[t] for t in told[0]]
        elif told:
            terms.append([t for words_ in told for t in words_])
    return terms


def covers(found: Column, terms: list[list[str]]) -> Column:
    """The cover density of terms whose occurrences are found, in order: an array of (place i, word w)."""
    if not terms:
        return F.lit(0.0)
    n = len(terms)
    begin = F.struct(F.lit(0.0).alias("total"), F.lit(-1).alias("begun"), F.array(*[F.lit(-1)] * n).alias("last"))

    def step(a: Column, e: Column) -> Column:
        last = F.array(*(F.when(e["w"].isin(*own), e["i"]).otherwise(a["last"][k]) for k, own in enumerate(terms)))
        first = F.array_min(last)
        new = first > a["begun"]
        return F.struct((a["total"] + F.when(new, F.lit(float(n)) / (e["i"] - first + 1)).otherwise(0.0)).alias("total"), F.when(new, first).otherwise(a["begun"]).alias("begun"), last.alias("last"))

    return F.aggregate(found, begin, step, lambda a: a["total"])


def cover_density_rank(words: Column, query: str, language: str | None = None) -> Column:
    """The cover density of a token array."""
    terms = cover_terms(query, language)
    wanted = {t for own in terms for t in own}
    return covers(F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda e: e["w"].isin(*wanted)), terms) if terms else F.lit(0.0)
