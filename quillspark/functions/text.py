"""Column builders for text: cleaning, term matching, labelled patterns."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: ColumnLike) -> Column:
    """Without leading and trailing white space of any script; ``trim`` knows the blank only."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def present(c: ColumnLike) -> Column:
    """True where a value is neither null nor blank: it is read up to the first character that is no white space."""
    return F.coalesce(F.rlike(col(c), F.lit(r"(?U)\S")), F.lit(False))


def squeeze(c: ColumnLike) -> Column:
    return strip(F.regexp_replace(col(c), r"(?U)\s+", " "))


def number(c: ColumnLike) -> Column:
    """As a double; null where the text is no number."""
    return strip(col(c).cast("string")).try_cast("double")


@cache
def _accents() -> tuple[str, str]:
    """Characters that are one base character with marks, and those bases: found by rule from the character database."""
    pairs = []
    for code in range(0xA0, sys.maxunicode + 1):
        char = chr(code)
        if unicodedata.decomposition(char) and not 0xAC00 <= code <= 0xD7A3:
            base = "".join(x for x in unicodedata.normalize("NFD", char) if unicodedata.category(x) != "Mn")
            if len(base) == 1 and base != char:
                pairs.append((char, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(c: ColumnLike) -> Column:
    """Accents and other nonspacing marks removed, without leaving the JVM; texts of ASCII only are passed through."""
    text = col(c)
    return F.when(F.rlike(text, F.lit(r"[^\x00-\x7F]")), F.translate(F.regexp_replace(text, r"\p{Mn}+", ""), *_accents())).otherwise(text)


@cache
def _single_capitals() -> tuple[str, str]:
    """Characters whose upper case is several, and the single capitals of those that have one."""
    several = [c for c in map(chr, range(sys.maxunicode + 1)) if len(c.upper()) > 1]
    pairs = [("ß", "ẞ"), *((c, c.title()) for c in several if len(c.title()) == 1 and c.title() != c)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def capital(c: ColumnLike) -> Column:
    """The first character in upper case, always one: ``upper`` makes two letters of a sharp s."""
    first = F.substring(col(c), 1, 1)
    return F.when(F.length(F.upper(first)) == 1, F.upper(first)).otherwise(F.translate(first, *_single_capitals()))


def joined_lower(fields: list[ColumnLike], padded: bool = False) -> Column:
    """The non-null fields joined by a blank, in lower case; ``padded`` adds a blank at both ends."""
    text = F.lower(F.concat_ws(" ", *[col(f) for f in fields]))
    return F.concat(F.lit(" "), text, F.lit(" ")) if padded else text


# One search for each term: for the short lists of a query; ``scan`` reads a text once for long ones.


def has(text: ColumnLike, term: str) -> Column:
    return F.contains(col(text), F.lit(term))


def any_term(text: ColumnLike, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [has(text, t) for t in terms], F.lit(False))


def term_score(text: ColumnLike, terms: list[str]) -> Column:
    """How many of the terms occur."""
    return reduce(lambda a, b: a + b, [has(text, t).cast("int") for t in terms], F.lit(0))


def matched_terms(text: ColumnLike, terms: list[str]) -> Column:
    """The terms that occur, trimmed, in the list's order, joined by ``"; "``."""
    return F.concat_ws("; ", *[F.when(has(text, t), F.lit(t.strip())) for t in terms])


def matches(text: ColumnLike, pattern: str) -> Column:
    return F.rlike(col(text), F.lit(f"(?iu){pattern}"))


def matched_labels(text: ColumnLike, patterns: dict[str, str]) -> Column:
    return F.concat_ws("; ", *[F.when(matches(text, p), F.lit(label)) for label, p in patterns.items()])


def title_key(c: ColumnLike) -> Column:
    """Lower case, no accents, letters a-z, digits and single blanks only."""
    plain = F.regexp_replace(strip_accents(F.lower(col(c))), r"(?U)[^a-z0-9\s]", "")
    return squeeze(plain)


def doi_key(c: ColumnLike) -> Column:
    """Lower case without resolver address or ``doi:``; empty for null."""
    return F.regexp_replace(F.coalesce(strip(F.lower(col(c))), F.lit("")), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")


def items(c: ColumnLike, separator: str = ";") -> Column:
    """The stripped, non-empty parts of a delimited field; no parts for null."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), separator), strip)
    return F.filter(parts, lambda x: F.length(x) > 0)
