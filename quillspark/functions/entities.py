"""Entities inside delimited fields: countries, institutions, authors, keywords, cited authors."""

from __future__ import annotations

import re
from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx
from .text import ColumnLike, any_term, capital, col, items, squeeze, strip, strip_accents


def lookup(table: dict[str, str], key: Column) -> Column:
    """The table's value, or the key itself."""
    mapping = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.coalesce(F.element_at(mapping, key), key)


def contains_any(text: Column, terms: list[str]) -> Column:
    return any_term(text, list(terms))


# Countries


def country(part: ColumnLike) -> Column:
    """The canonical name; null for blank and missing-value words."""
    key = squeeze(F.lower(col(part)))
    named = F.element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(lx.COUNTRY_ALIASES.items())]), key)
    return F.when((key != "") & ~key.isin("nan", "none", "null", "n/a"), F.coalesce(named, F.initcap(key)))


def _suffix_country(segment: Column) -> Column:
    parts = items(segment, ",")
    return F.when(F.size(parts) > 0, country(F.element_at(parts, -1)))


def countries(addresses: ColumnLike) -> Column:
    """The distinct countries of all ``;`` segments, sorted; empty for null."""
    found = F.transform(F.split(F.coalesce(col(addresses), F.lit("")), ";"), _suffix_country)
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))


def leading_country(addresses: ColumnLike) -> Column:
    """That of the first segment, null if it has none."""
    return _suffix_country(F.element_at(F.split(F.coalesce(col(addresses), F.lit("")), ";"), 1))


# Names


def standard_affiliations(c: ColumnLike) -> Column:
    """Whole-word abbreviations replaced in the table's order; each rule is tried only where its words occur."""

    def rule(text: Column, pair: tuple[str, str]) -> Column:
        short, full = pair
        return F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}_]){re.escape(short)}(?![\p{{L}}\p{{N}}_])", full.replace("\\", r"\\").replace("$", r"\$"))

    return reduce(rule, lx.AFFILIATION_NAMES.items(), col(c))


def _spaced_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(squeeze(name), r",\s*", ", "), r"\.(?=[A-Za-z])", ". ")


def standard_author(c: ColumnLike) -> Column:
    """No accents, single blanks, one after each comma and initial."""
    return _spaced_name(strip_accents(c))


def standard_authors(c: ColumnLike) -> Column:
    """``standard_author`` for each part of a ``;`` list; null stays null."""
    return F.when(col(c).isNotNull(), F.array_join(F.transform(items(strip_accents(c)), _spaced_name), "; "))


def author_names(c: ColumnLike) -> Column:
    """The names of a ``;`` list without what follows a parenthesis."""
    return F.filter(F.transform(items(c), lambda x: strip(F.substring_index(x, "(", 1))), lambda x: x != "")


def first_author_key(ids: ColumnLike, names: ColumnLike) -> Column:
    """The first id of a list, else the first name in lower case, else empty."""
    first = lambda c: strip(F.substring_index(F.coalesce(col(c), F.lit("")), ";", 1))
    return F.when(first(ids) != "", first(ids)).otherwise(F.lower(first(names)))


# Institutions


def _parent(label: Column) -> Column:
    """A university's label without an attached sub-unit."""
    label = squeeze(label)
    cut = strip(F.regexp_replace(label, rf"(?i)\s+(?:{'|'.join(lx.ATTACHED_UNIT_WORDS)})\b.*$", ""))
    kept = F.when(F.contains(F.lower(label), F.lit("university college")), label).otherwise(cut)
    return F.when(F.lower(kept).isin("the university of hong kong", "university of hong kong"), F.lit("The University of Hong Kong")).otherwise(kept)


def _institution(segment: Column) -> Column:
    """The institution of one address, by the first rule that speaks; null if none does."""
    lower = F.lower(segment)
    named = F.lit(None).cast("string")
    for name, variants in reversed(lx.INSTITUTION_ALIASES.items()):
        test = contains_any(lower, variants)
        if name.endswith("(MIT)"):
            test = test | F.rlike(lower, F.lit(r"\bmit\b"))
        named = F.when(test, F.lit(name)).otherwise(named)
    parts = items(segment, ",")
    generic = lambda p: F.lower(p).isin(*lx.GENERIC_LABELS)
    universities = F.filter(parts, lambda p: contains_any(F.lower(p), lx.UNIVERSITY_MARKERS) & ~generic(p))
    markers = [*lx.UNIVERSITY_MARKERS, *lx.ORGANISATION_MARKERS]
    unit = rf"(?i)^(?:{'|'.join(lx.SUB_UNIT_WORDS)})\b"
    bodies = F.filter(parts, lambda p: contains_any(F.lower(p), markers) & ~F.rlike(p, F.lit(unit)) & ~generic(p))
    colleges = F.filter(parts, lambda p: F.contains(F.lower(p), F.lit("college")) & ~F.rlike(p, F.lit(r"(?i)^college\s+of\b")))
    parent = _parent(F.get(universities, F.lit(0)))
    return (
        F.when(named.isNotNull(), named)
        .when(F.lower(F.get(parts, F.lit(0))).isin("københavn", "copenhagen"), F.lit("Københavns Universitet"))
        .when(F.size(universities) > 0, F.when(~generic(parent), parent))
        .when(F.size(bodies) > 0, F.get(bodies, F.lit(0)))
        .otherwise(F.get(colleges, F.lit(0)))
    )


def institutions(addresses: ColumnLike) -> Column:
    """The distinct parent institutions of all segments, sorted."""
    kept = F.filter(items(addresses), lambda s: F.lower(s) != "nan")
    return F.array_sort(F.array_distinct(F.filter(F.transform(kept, _institution), lambda x: x.isNotNull())))


def display_institution(address: ColumnLike) -> Column:
    """A short label of one address: a known name, else the most telling part with the last one, 40 characters at most."""
    raw = col(address)
    lower = F.lower(raw)
    known = F.lit(None).cast("string")
    for key, label in reversed(lx.DISPLAY_INSTITUTIONS.items()):
        known = F.when(F.contains(lower, F.lit(key)), F.lit(label)).otherwise(known)
    parts = F.transform(F.split(raw, ","), strip)
    told = F.filter(parts, lambda p: (F.length(p) >= 3) & contains_any(F.lower(p), lx.DISPLAY_TARGETS))
    second, last = F.get(parts, F.lit(1)), F.element_at(parts, -1)
    best = F.coalesce(F.get(told, F.lit(0)), F.when(F.length(second) > 3, second), F.get(parts, F.lit(0)))
    label = F.when(last != "", F.concat(best, F.lit(" ("), last, F.lit(")"))).otherwise(best)
    short = F.when(F.length(label) > 40, F.concat(F.substring(label, 1, 40), F.lit(".."))).otherwise(label)
    return F.when(F.length(raw) >= 3, F.coalesce(known, short))


# Keywords and references


def keywords(c: ColumnLike, shortest: int = 3) -> Column:
    """Lower-case parts of a ``;`` list of at least ``shortest`` characters."""
    return F.filter(F.transform(items(c), F.lower), lambda k: F.length(k) >= shortest)


def keyword_tokens(c: ColumnLike) -> Column:
    """Lower-case parts with single blanks, of any length."""
    return F.transform(items(c), lambda k: F.lower(squeeze(k)))


def mapped_keywords(words: ColumnLike, table: dict[str, str] | None = None, merged: dict[str, str] | None = None) -> Column:
    """Each keyword by the fixed table, then by the merged spellings, first occurrences only."""
    table = lx.KEYWORD_MAP if table is None else table
    out = F.transform(col(words), lambda k: lookup(table, k))
    if merged:
        out = F.transform(out, lambda k: lookup(merged, k))
    return F.array_distinct(out)


def cited_author(reference: ColumnLike) -> Column:
    """``Surname, I.N.`` of the first author of a cited work; null where the start is no person."""
    parts = F.transform(F.split(col(reference), ","), strip)
    surname, given = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    tokens = F.regexp_extract_all(given, F.lit("([A-Za-zÀ-ž]+)"), F.lit(1))
    person = (
        (F.size(parts) >= 3) & F.length(surname).between(1, 45) & ~F.lower(surname).isin(*lx.NOT_AUTHORS)
        & F.rlike(surname, F.lit("[A-Za-zÀ-ž]")) & (F.length(given) <= 50) & F.size(tokens).between(1, 5)
    )
    initials = F.array_join(F.transform(tokens, capital), ".")
    return F.when(person, squeeze(F.concat(surname, F.lit(", "), initials, F.lit("."))))


def cited_authors(references: ColumnLike) -> Column:
    """The distinct first authors of a ``;`` list of cited works, sorted."""
    found = F.transform(items(references), cited_author)
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))
