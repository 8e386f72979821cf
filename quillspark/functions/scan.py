"""Many terms of one text: searched for by workers where all that occur are wanted; whether one occurs is a search for each or, for long lists, a trie of all terms as one pattern."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnLike, any_term, col


#: Terms from which one pass by the trie is cheaper than a search for each: measured on 25 MB of texts, a pass takes as long as about this many searches, whatever the number of terms.
LONG_LIST = 100


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _quoted(char: str) -> str:
    return char if char.isalnum() or ord(char) > 127 or char == " " else "\\" + char


@cache
def trie_pattern(terms: tuple[str, ...]) -> str:
    """A pattern that matches the longest of the terms at a position; shared beginnings are read once, so its cost is that of one path."""
    trie: dict = {}
    for term in terms:
        at = trie
        for char in term:
            at = at.setdefault(char, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        branches = [_quoted(char) + pattern(below) for char, below in at.items() if char]
        if not branches:
            return ""
        whole = branches[0] if len(branches) == 1 and "" not in at else "(?:" + "|".join(branches) + ")"
        return whole + ("?" if "" in at else "")

    return pattern(trie)


def found_terms(text: ColumnLike, terms: Iterable[str]) -> Column:
    """The terms that occur anywhere in the text, in the list's order, also where they overlap or lie inside each other; null for a null text.

    Workers search for each term: ``contains`` reads a text byte by byte for
    every term, Python's search skips most of it.
    """
    terms = tuple(terms)
    if not terms:
        return F.when(col(text).isNotNull(), F.array().cast("array<string>"))
    if "" in terms:
        raise ValueError("a term is empty")

    def held(texts: pa.Array) -> pa.Array:
        found = ([term for term in terms if term in t] if (t := value.as_py()) is not None else None for value in texts)
        return pa.array(found, pa.list_(pa.string()))

    # called so, filters on what follows from the terms are not pushed below the search, which would run it again
    return F.arrow_udf(held, "array<string>").asNondeterministic()(col(text))


def among(found: Column, terms: Iterable[str]) -> Column:
    """Those of the terms that were found, in their list's order."""
    return F.filter(F.array(*map(F.lit, terms)), lambda term: F.array_contains(found, term))


def has_any(found: Column, terms: Iterable[str]) -> Column:
    return F.arrays_overlap(found, F.array(*map(F.lit, terms)))


def any_of(text: ColumnLike, terms: Iterable[str]) -> Column:
    """Whether one of the terms occurs; null for a null text."""
    terms = tuple(terms)
    if "" not in terms and 0 < len(terms) < LONG_LIST:
        return bound(col(text), lambda whole: any_term(whole, list(terms)))
    return F.rlike(col(text), F.lit(trie_pattern(terms))) if terms else F.when(col(text).isNotNull(), F.lit(False))


def certain_part(pattern: str) -> str:
    """The longest run of plain characters that every match of the pattern holds; empty where the pattern is not made of such runs, ``\\b``, optional characters and groups ``(?:...)``."""
    plain = re.sub(r"\(\?:[^()]*\)[?]?|.\?", "\0", pattern.replace(r"\b", "\0"))
    return max(plain.split("\0"), key=len) if re.fullmatch(r"[a-z \0-]*", plain) else ""


def found_patterns(text: ColumnLike, patterns: Iterable[str]) -> Column:
    """Those of the patterns that match in the text, in the list's order; a pattern is tried only where its certain part occurs."""
    patterns = tuple(patterns)
    parts = {p: certain_part(p) for p in patterns}

    def tried(read: Column) -> Column:
        whole, found = read["whole"], read["found"]
        met = {p: F.when(F.rlike(whole, F.lit(p)), F.lit(p)) for p in patterns}
        return F.array_compact(F.array(*[F.when(F.array_contains(found, part), met[p]) if part else met[p] for p, part in parts.items()]))

    found = found_terms(text, dict.fromkeys(part for part in parts.values() if part))
    return bound(F.struct(col(text).alias("whole"), found.alias("found")), tried)


def cue_windows(text: ColumnLike, patterns: Iterable[str], words: int) -> Column:
    """The words from each place on at which one of the patterns matches, ``words`` at most, one place a line; one pass over the text.

    A pattern that begins at a word and spans no more than so many words
    matches somewhere in the text exactly if it matches in these lines: they
    begin and end where words of the text do.
    """
    word = r"[\p{L}\p{N}_]+"
    places = rf"(?iu)(?=(?:{'|'.join(f'(?:{p})' for p in patterns)}))(?=({word}(?:[^\p{{L}}\p{{N}}_]{word}){{0,{words - 1}}}))"
    return F.array_join(F.array_distinct(F.regexp_extract_all(col(text), F.lit(places), F.lit(1))), "\n")


def pattern_words(patterns: Iterable[str]) -> int:
    """How many words the longest of the patterns spans."""
    return max(len(re.split(r"[ ]", p)) for p in patterns)
