"""Personal data: candidate spans, boosted trees over their format and context, calibrated thresholds."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from functools import partial
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_prefix, table, without

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. A match can only begin at the start of a run of its first class or where the last match ended
#: (``\G``), and runs are possessive: that gives the plain patterns' matches in linear time.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: High-recall generators of further spans, by the kind they propose.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\{dot\}|\.) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9A-Za-z.])[0-9]{4}(?:[ ./_-]{1,2}[0-9]{3,6}){2,3}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.])\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}[0-9]{2,4}){2,4}(?![0-9A-Za-z])",
}
CONTEXT = 24
_OPEN, _CLOSE, _OTHER = "\x01", "\x02", "\x03"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_WORDS = {
    "phone": r"(?i)\b(?:tel|phone|telephone|mobile|cell|call|fax|whatsapp|sms|telefon|tél|teléfono|móvil|handy)\b[^0-9A-Za-z]{0,4}\(?$",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)\b(?: ?(?:no|number|nr|num))?[^0-9A-Za-z]{0,4}$",
    "mail": r"(?i)\b(?:mail|email|e-mail|contact|write|reach|correo|courriel)\b[^0-9A-Za-z]{0,4}$",
    "address": r"(?i)\b(?:ip|ipv6|host|server|address|client|from)\b[^0-9A-Za-z]{0,4}$",
    "other": r"(?i)\b(?:order|invoice|version|isbn|issn|date|page|section|ref|id|serial|no|build|vol)\b[^0-9A-Za-z]{0,4}$",
}
FEATURES = (
    "email", "ip", "card", "phone", "context_phone", "context_card", "context_mail", "context_address", "context_other",
    "luhn", "digits_7_9", "digits_10_11", "digits_12_plus", "parenthesis", "one_separator", "dotted", "date_like", "closed",
)


_SPANS = "array<struct<start:int,end:int,match:string,before:string,after:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _side(items: Column) -> Column:
    """Length of the blocks that an array is cut into: the root of its size, so that work on it grows with size times root."""
    return F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items)))).cast("int")


def _blocks(items: Column, side: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of every block of a non-empty array."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / side).cast("int")), lambda b: _let(F.slice(items, b * side + 1, side), body))


def found(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, match, before, after) by code points, end exclusive.

    Matches are marked and the text is split at the marks. A match starts
    where the pieces before it end: whole blocks of pieces are summed first,
    then those of its own block; the context comes from the neighbours.
    """
    total = lambda lengths: F.aggregate(lengths, F.lit(0), lambda a, x: a + x)
    first_part, last_part = (lambda p: F.substring_index(p, _CLOSE, 1)), (lambda p: F.substring_index(p, _CLOSE, -1))

    def spans(pieces: Column, lengths: Column, side: Column, sums: Column) -> Column:
        def span(i: Column) -> Column:
            own, block = F.get(pieces, i), F.floor(i / side).cast("int")
            at = F.get(sums, block) + total(F.slice(lengths, block * side + 1, i - block * side))
            match, before = first_part(own), F.right(last_part(F.get(pieces, i - 1)), F.lit(CONTEXT))
            return _let(at, lambda a: F.struct(a.alias("start"), (a + F.length(match)).alias("end"), match.alias("match"), before.alias("before"), F.substring(last_part(own), 1, 2).alias("after")))

        return F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), span)

    def located(pieces: Column) -> Column:
        lengths = F.transform(pieces, lambda p, i: F.length(p) - F.when(i > 0, 1).otherwise(0))  # the closing mark is no text
        starts = lambda totals: F.transform(totals, lambda _, b: total(F.slice(totals, F.lit(1), b)))
        summed = lambda ls: _let(_side(ls), lambda n: _let(_let(_blocks(ls, n, total), starts), lambda sums: spans(pieces, ls, n, sums)))
        return F.when(F.size(pieces) > 1, _let(lengths, summed)).otherwise(F.array().cast(_SPANS))

    return _let(F.split(F.regexp_replace(text, f"({pattern})", f"{_OPEN}$1{_CLOSE}"), _OPEN, -1), located)


def _free(items: Column, others: Column, yields: Callable[[Column, Column], Column]) -> Column:
    """The items that yield to no overlapping one of the others; only blocks of others that an item meets are opened."""
    overlap = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    extent = lambda part: F.struct(F.array_min(F.transform(part, lambda x: x["start"])).alias("start"), F.array_max(F.transform(part, lambda x: x["end"])).alias("end"), part.alias("part"))
    met = lambda c, blocks: F.exists(blocks, lambda b: overlap(b, c) & F.exists(b["part"], lambda o: overlap(o, c) & yields(c, o)))
    kept = lambda blocks: F.filter(items, lambda c: ~met(c, blocks))
    return F.when(F.size(others) > 0, _let(_blocks(others, _side(others), extent), kept)).otherwise(items)


def marks_removed(text: Column) -> Column:
    """The text without the two marks, each replaced by another control character that no pattern knows."""
    return F.translate(F.coalesce(text, F.lit("")), _OPEN + _CLOSE, _OTHER + _OTHER)


def _guarded(text: Column, pattern: str, needs: str | None) -> Column:
    holds = F.contains(text, F.lit(needs)) if needs else F.rlike(text, F.lit("[0-9]"))
    return F.when(holds, found(text, pattern)).otherwise(F.array().cast(_SPANS))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def valid(kind: str, match: Column) -> Column:
    n = F.length(digits(match))
    if kind == "ip":
        return F.rlike(match, F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
    if kind == "card":
        return n.between(14, 19) & F.call_function("luhn_check", digits(match))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def features(kind: Column, match: Column, before: Column, after: Column) -> list[Column]:
    """Yes-or-no features of a candidate, as named in ``FEATURES``."""
    number = digits(match)
    n = F.length(number)
    separators = F.array_distinct(F.regexp_extract_all(match, F.lit("([^0-9A-Za-z()]+)"), F.lit(1)))
    context = [F.rlike(before, F.lit(p)) for p in _WORDS.values()]
    return [
        *[kind == k for k in KINDS],
        *context,
        n.between(13, 19) & F.call_function("luhn_check", number),
        n.between(7, 9),
        n.between(10, 11),
        n >= 12,
        F.contains(match, F.lit("(")),
        F.size(separators) == 1,
        F.contains(match, F.lit(".")),
        F.rlike(match, F.lit(r"^(?:19|20)[0-9]{2}[-./ ][01]?[0-9][-./ ][0-3]?[0-9]|^[0-3]?[0-9][-./][01]?[0-9][-./](?:19|20)?[0-9]{2}$")),
        F.rlike(after, F.lit(r"^(?:$|[\s,;.!?)])")),
    ]


def training_rows(n: int = 1200, seed: int = 7) -> list[tuple[str, str, str, str, int]]:
    """Labelled candidates (kind, match, before, after, label) made by rule: numbers and addresses with and without personal use."""
    rng = random.Random(seed)
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))

    def card(k: int) -> str:
        body = rng.choice("3456") + number(k - 2)
        total = sum((d if i % 2 else (d * 2 - 9 if d > 4 else d * 2)) for i, d in enumerate(map(int, reversed(body))))
        return body + str(-total % 10)

    def grouped(digits_: str, sep: str) -> str:
        return sep.join(digits_[i : i + 4] for i in range(0, len(digits_), 4))

    rows = []
    for _ in range(n):
        before, after = f"{word()} {word()} ", rng.choice((" ", ", ", ". ", ""))
        sep = rng.choice((" ", "-", "."))
        case = rng.randrange(13)
        if case == 0:
            rows.append(("phone", f"({number(3)}) {number(3)}-{number(4)}", before, after, 1))
        elif case == 1:
            rows.append(("phone", f"0{number(3)}{sep}{number(3)}{sep}{number(4)}", before + rng.choice(("tel: ", "phone ", "call ", "fax: ", "mobile: ")), after, 1))
        elif case == 2:
            rows.append(("email", f"{word()}{rng.choice((' [at] ', '[at]', '(at)'))}{word()}{rng.choice((' [dot] ', '[dot]', '.'))}com", before + rng.choice(("", "mail ", "contact: ")), after, 1))
        elif case == 3:
            rows.append(("card", grouped(card(16), rng.choice((".", "/", "_"))), before + rng.choice(("", "card ", "visa: ")), after, 1))
        elif case == 4:
            rows.append(("ip", ":".join(rng.choice(("2001", "0db8", "fe80", number(4), number(2))) for _ in range(8)), before + rng.choice(("", "ip ", "host ")), after, 1))
        elif case == 5:
            rows.append(("phone", f"{rng.randint(1950, 2030)}{sep}{rng.randint(1, 12):02d}{sep}{rng.randint(1, 28):02d}", before + rng.choice(("", "date ")), after, 0))
        elif case == 6:
            rows.append(("phone", sep.join(number(rng.randint(2, 3)) for _ in range(rng.randint(3, 5))), before + rng.choice(("", "version ", "section ", "page ")), after, 0))
        elif case == 7:
            rows.append(("card", grouped(number(rng.choice((12, 15, 16))), sep), before + rng.choice(("", "order ", "invoice ", "isbn ")), after, 0))
        elif case == 8:
            rows.append(("phone", f"{number(3)}{sep}{number(4)}{sep}{number(4)}", before + rng.choice(("order ", "ref ", "serial ", "", "")), after, 0))
        elif case == 9:
            rows.append(("phone", f"{number(3)} {number(3)} {number(3)}", before, after, 0))
        elif case == 10:
            rows.append(("phone", f"{number(2)}{sep}{number(2)}{sep}{number(4)}", before + rng.choice(("date: ", "")), after, 0))
        elif case == 11:
            rows.append(("phone", f"{rng.randint(1950, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}{rng.choice((' ', '-'))}{number(2)}{sep}{number(2)}" + rng.choice(("", f"{sep}{number(2)}")), before + rng.choice(("", "on ", "date ")), after, 0))
        else:
            rows.append(("card", grouped(number(16), "/"), before + rng.choice(("id ", "no ")), after, 0))
    return rows


class BoostedTrees:
    """Trees of two questions fitted to the gradient of the logistic loss."""

    def __init__(self, rounds: int = 24, rate: float = 0.4, penalty: float = 1.0):
        self.rounds, self.rate, self.penalty = rounds, rate, penalty
        self.trees: list[tuple[int, int, tuple[float, float, float, float]]] = []
        self.base = 0.0

    def fit(self, rows: list[tuple[tuple[int, ...], int]]) -> BoostedTrees:
        positive = sum(y for _, y in rows)
        self.base = math.log((positive + 1) / (len(rows) - positive + 1))
        margin = [self.base] * len(rows)
        pairs = list(combinations(range(len(FEATURES)), 2))
        for _ in range(self.rounds):
            grad = [y - 1 / (1 + math.exp(-m)) for m, (_, y) in zip(margin, rows, strict=True)]
            hess = [max(1e-6, (y - g) * (1 - y + g)) for g, (_, y) in zip(grad, rows, strict=True)]
            groups: dict[tuple[int, ...], list[float]] = {}
            for (x, _), g, h in zip(rows, grad, hess, strict=True):
                at = groups.setdefault(x, [0.0, 0.0])
                at[0] += g
                at[1] += h
            best = None
            for i, j in pairs:
                cells = [[0.0, 0.0] for _ in range(4)]
                for x, (g, h) in groups.items():
                    cell = cells[2 * x[i] + x[j]]
                    cell[0] += g
                    cell[1] += h
                gain = sum(g * g / (h + self.penalty) for g, h in cells)
                if best is None or gain > best[0] + 1e-12:
                    best = gain, i, j, tuple(self.rate * g / (h + self.penalty) for g, h in cells)
            _, i, j, leaves = best
            self.trees.append((i, j, leaves))
            margin = [m + leaves[2 * x[i] + x[j]] for m, (x, _) in zip(margin, rows, strict=True)]
        return self

    def margin(self, x: tuple[int, ...]) -> float:
        return self.base + sum(leaves[2 * x[i] + x[j]] for i, j, leaves in self.trees)

    def column(self, features_: list[Column]) -> Column:
        score = F.lit(self.base)
        for i, j, (n, b, a, ab) in self.trees:
            a_, b_ = features_[i], features_[j]
            score = score + F.when(a_ & b_, F.lit(ab)).when(a_, F.lit(a)).when(b_, F.lit(b)).otherwise(F.lit(n))
        return score


def calibrated_threshold(scored: list[tuple[float, int]], precision: float = 0.98) -> float:
    """The least margin from which rows of the validation part are personal with the wanted precision (smoothed); infinite if none is; never under even odds."""
    best, right, seen = math.inf, 0, 0
    for score, label in sorted(scored, reverse=True):
        right, seen = right + label, seen + 1
        if (right + 1) / (seen + 1) >= precision:
            best = max(score, 0.0)
    return best


def train(spark: SparkSession) -> tuple[BoostedTrees, dict[str, float]]:
    """The trees and a threshold for each kind, from rows made by rule: two thirds fit, one third calibrates."""
    rows = training_rows()
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, kind string, match string, before string, after string, label int")
    columns = [F.coalesce(f, F.lit(False)).cast("int").alias(f"f{n}") for n, f in enumerate(features(*[F.col(c) for c in ("kind", "match", "before", "after")]))]
    got = [(tuple(r[2:]), r[1], r[0]) for r in frame.select("kind", "label", "i", *columns).orderBy("i").select("kind", "label", *[f"f{n}" for n in range(len(columns))]).collect()]
    trees = BoostedTrees().fit([(x, y) for n, (x, y, _) in enumerate(got) if n % 3])
    held = {k: [(trees.margin(x), y) for n, (x, y, kind) in enumerate(got) if n % 3 == 0 and kind == k] for k in KINDS}
    return trees, {k: calibrated_threshold(v) for k, v in held.items()}


def _is_valid(kind: str, span: Column) -> Column:
    return F.coalesce(valid(kind, span["match"]), F.lit(False))


def _scored(trees: BoostedTrees, kind: str, span: Column) -> Column:
    """The candidate as a struct whose greatest value is the one to prefer."""
    known = [F.coalesce(f, F.lit(False)) for f in features(F.lit(kind), span["match"], span["before"], span["after"])]
    return F.struct(
        trees.column(known).alias("score"),
        (-span["start"]).alias("first"),
        span["end"].alias("end"),
        F.lit(KINDS.index(kind)).alias("kind_no"),
        span["start"].alias("start"),
        F.lit(kind).alias("kind"),
    )


def _reaches(threshold: float, candidate: Column) -> Column:
    return candidate["score"] >= threshold


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs``, ``base_spans`` and ``pii_spans``: arrays of (start, kind_no, end, kind) by start, then kind as listed.

    The base spans are the valid matches of the four patterns and always stay.
    The generators' spans join them where the trees' score reaches the kind's
    threshold and no base span overlaps; of overlapping ones the higher score
    stays, then the earlier, then the longer. A null text counts as empty and,
    as a text without personal data, gives empty arrays; repeated rows give
    equal results, with null ids too; texts of any length are searched whole,
    spans in blocks; existing columns of the new names are replaced.
    """
    trees, thresholds = train(docs.sparkSession)
    docs = without(docs, "base_spans", "pii_spans")
    p = free_prefix(docs)
    marked, more_ = f"{p}clean", f"{p}wide"
    clean = docs.withColumn(marked, marks_removed(F.col(text)))

    def plain(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    base, wide = [], []
    for kind in KINDS:
        spans = _guarded(F.col(marked), BASE[kind], NEEDS[kind])
        base.append(plain(kind, F.filter(spans, partial(_is_valid, kind))))
        if math.isfinite(thresholds[kind]):
            spans = _guarded(F.col(marked), WIDE[kind], {"email": "at", "ip": ":"}.get(kind))
            scored = F.transform(spans, partial(_scored, trees, kind))
            wide.append(F.filter(scored, partial(_reaches, thresholds[kind])))
    staged = clean.withColumn("base_spans", F.array_sort(F.concat(*base)))
    if wide:
        staged = staged.withColumn(more_, F.concat(*wide))
        staged = staged.withColumn(more_, _free(F.col(more_), F.col("base_spans"), lambda c, o: F.lit(True)))
        more = _free(F.col(more_), F.col(more_), lambda c, o: o > c)
        more = F.transform(more, lambda c: F.struct(c["start"].alias("start"), c["kind_no"].alias("kind_no"), c["end"].alias("end"), c["kind"].alias("kind")))
        staged = staged.withColumn("pii_spans", F.array_sort(F.concat("base_spans", more))).drop(more_)
    else:
        staged = staged.withColumn("pii_spans", F.col("base_spans"))
    return staged.drop(marked)


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``detect`` and ``redacted``: the text with every span, overlapping ones as one, replaced by its first kind in brackets."""
    found_ = detect(docs, text)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        kept = F.substring(F.col(text), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], kept, F.lit("["), s["kind"], F.lit("]"))).alias("out"))

    tail = lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text)))
    return found_.withColumn("redacted", F.aggregate("pii_spans", start, step, tail))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found_ = detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found_.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("pii_spans").alias("spans"))
