"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, free_prefix, stored, table, without

MARGINS = ("source", "lang", "topic")
#: A target share is the corpus share to this power, scaled to 1, where no target is given.
TEMPER = 0.7
#: Share of all tokens that the sample is to hold.
BUDGET = 0.9
ITERATIONS = 200
TOLERANCE = 1e-9
#: Cells (combinations of margin values) that the driver fits; more of them are fitted by DataFrame, if ``spread`` allows, or are an error.
MAX_CELLS = 500_000
#: Sweeps over the margins, and the change of a factor at which they end, of the fit by DataFrame.
SPREAD_SWEEPS = 60
SPREAD_TOLERANCE = 1e-4

#: Topics are registers, told by what a text is written in; the first rule that holds names it.
#: Terms of notices and grants; first letters are left out, as either case may begin them.
LEGAL_TERMS = ("opyright", "icense", "arranty")
#: Signs of code and markup, and their least share of the characters.
SIGNS = "{}<>=;|\\^~`#@$%&*_[]"
SIGN_SHARE = 0.04
DIGIT_SHARE = 0.1
#: Texts of so many lines or more, of fewer characters a line than this, are lists.
LIST_LINES, LIST_CHARS = 5, 60
OTHER_TOPIC = "prose"


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def topic(text: Column) -> Column:
    """``legal``, ``markup``, ``figures``, ``list`` or ``prose``."""
    n, lines = F.length(text), _count(text, "\n") + 1
    return (
        F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in LEGAL_TERMS]), F.lit("legal"))
        .when((n > 0) & (_count(text, SIGNS) >= SIGN_SHARE * n), F.lit("markup"))
        .when((n > 0) & (_count(text, "0123456789") >= DIGIT_SHARE * n), F.lit("figures"))
        .when((lines >= LIST_LINES) & (n < LIST_CHARS * lines), F.lit("list"))
        .otherwise(F.lit(OTHER_TOPIC))
    )


def tokens(text: Column) -> Column:
    """Blanks plus one: the number of tokens that single blanks part; 0 for an empty text."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text == "", F.lit(0)).otherwise(_count(text, " \n\t\r") + 1).cast("long")


def rake(cells: dict[tuple, float], targets: list[dict], iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> dict[tuple, float]:
    """Factor of each cell, so that the weighted cells have the target shares of every margin, as far as the cells allow."""
    weight = dict.fromkeys(cells, 1.0)
    total = math.fsum(cells.values())
    for _ in range(iterations):
        worst = 0.0
        for m, target in enumerate(targets):
            sums: dict = {}
            for cell, n in cells.items():
                sums[cell[m]] = sums.get(cell[m], 0.0) + n * weight[cell]
            factor = {v: target.get(v, 0.0) * total / s if s > 0 else 0.0 for v, s in sums.items()}
            worst = max([worst, *(abs(f - 1) for f in factor.values())])
            for cell in weight:
                weight[cell] *= factor[cell[m]]
        if worst < tolerance:
            break
    return weight


def calibrate(cells: dict[tuple, float], weight: dict[tuple, float], budget: float) -> float:
    """The scale at which probabilities min(1, scale * weight) keep ``budget`` of all tokens, or as many as positive weights can."""
    total = math.fsum(cells.values())
    if total <= 0:
        return 1.0
    kept = lambda c: math.fsum(n * min(1.0, c * weight[k]) for k, n in cells.items())
    low, high = 0.0, 1.0
    most = math.fsum(n for k, n in cells.items() if weight[k] > 0)
    want = min(budget * total, most)
    for _ in range(200):
        if kept(high) >= want * (1 - 1e-12):
            break
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (low, mid) if kept(mid) >= want else (mid, high)
    return high


def reachable(share: dict, have: dict, total: float) -> dict:
    """Goals in tokens: ``total`` dealt by share, where a value has fewer all of them, and what is missing by share among the others."""
    goal, left = {}, {v: s for v, s in share.items() if s > 0 and have.get(v, 0.0) > 0}
    while left:
        level = max(0.0, total - math.fsum(goal.values())) / math.fsum(left.values())
        cut = {v for v, s in left.items() if have[v] <= level * s}
        if not cut:
            return goal | {v: level * s for v, s in left.items()}
        goal |= {v: have[v] for v in cut}
        left = {v: s for v, s in left.items() if v not in cut}
    return goal


def _step(goal: float, cut: float, free: float) -> float:
    """The factor of a margin value whose cells at probability 1 hold ``cut`` tokens and the others ``free`` weighted ones."""
    if goal > cut:
        return (goal - cut) / free if free > 0 else 1.0
    return goal / (cut + free) if cut + free > 0 else 1.0


def bounded(cells: dict[tuple, float], weight: dict[tuple, float], goals: list[dict], iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> dict[tuple, float]:
    """Weights whose probabilities min(1, weight) keep the goals' tokens of every margin: cells cut at 1 stay there and the rest are raked again.

    Where goals of several margins contradict each other, the sweeps end after
    ``iterations`` at a compromise; ``gaps`` tells how far it is off.
    """
    weight = dict(weight)
    for _ in range(iterations):
        worst = 0.0
        for m, goal in enumerate(goals):
            cut: dict = {}
            free: dict = {}
            for cell, n in cells.items():
                w = weight[cell]
                if w >= 1:
                    cut[cell[m]] = cut.get(cell[m], 0.0) + n
                else:
                    free[cell[m]] = free.get(cell[m], 0.0) + n * w
            factor = {v: _step(goal.get(v, 0.0), cut.get(v, 0.0), free.get(v, 0.0)) for v in cut.keys() | free.keys()}
            worst = max([worst, *(abs(f - 1) for f in factor.values())])
            for cell in weight:
                weight[cell] = min(1e9, weight[cell] * factor[cell[m]])
        if worst < tolerance:
            break
    return weight


def tempered(cells: dict[tuple, float], margin: int, power: float = TEMPER) -> dict:
    sums: dict = {}
    for cell, n in cells.items():
        sums[cell[margin]] = sums.get(cell[margin], 0.0) + n
    scaled = {v: s**power for v, s in sums.items() if s > 0}
    total = math.fsum(scaled.values())
    return {v: x / total for v, x in scaled.items()} if total else {}


def gaps(cells: dict[tuple, float], prob: dict[tuple, float], shares: list[dict]) -> list[dict]:
    """For each margin, the reached share of every value less its target share."""
    kept = {c: n * prob[c] for c, n in cells.items()}
    total = math.fsum(kept.values())
    out = []
    for m, share in enumerate(shares):
        sums: dict = {}
        for cell, n in kept.items():
            sums[cell[m]] = sums.get(cell[m], 0.0) + n
        out.append({v: (s / total if total else 0.0) - share.get(v, 0.0) for v, s in sums.items()})
    return out


def fit(cells: dict[tuple, float], targets: dict[str, dict] | None = None, budget: float = BUDGET) -> tuple[dict[tuple, float], list[dict]]:
    """Weights of the cells and the target shares of the margins: raked, scaled to the budget, and raked again within probability 1."""
    shares = [(targets or {}).get(m) or tempered(cells, i) for i, m in enumerate(MARGINS)]
    weight = rake(cells, shares)
    scale = calibrate(cells, weight, budget)
    weight = {c: scale * w if cells[c] > 0 else scale for c, w in weight.items()}
    open_ = {c: n for c, n in cells.items() if n > 0 and weight[c] > 0}
    total = min(budget * math.fsum(cells.values()), math.fsum(open_.values()))
    goals = []
    for m, share in enumerate(shares):
        have: dict = {}
        for cell, n in open_.items():
            have[cell[m]] = have.get(cell[m], 0.0) + n
        goals.append(reachable(share, have, total))
    return weight | bounded(open_, {c: weight[c] for c in open_}, goals), shares


def _fit_spread(cells: DataFrame, targets: dict[str, dict] | None, budget: float) -> DataFrame:
    """``fit`` by DataFrame: ``cells(source, lang, topic, n)`` with ``weight`` and a gap for each margin, for any number of cells."""
    spark = cells.sparkSession
    cells = stored(cells)
    total = budget * (cells.agg(F.sum("n")).first()[0] or 0)
    shares = []
    for m in MARGINS:
        have = cells.groupBy(m).agg(F.sum("n").cast("double").alias("have"))
        if given := (targets or {}).get(m):
            listed = spark.createDataFrame([(v, float(s)) for v, s in given.items()], f"v {cells.schema[m].dataType.simpleString()}, share double")  # the caller's list
            joined = have.join(listed, F.col(m).eqNullSafe(F.col("v")), "left").select(m, "have", F.coalesce("share", F.lit(0.0)).alias("share"))
        else:
            of_all = have.agg(F.sum(F.pow("have", F.lit(TEMPER)))).first()[0] or 1.0
            joined = have.withColumn("share", F.pow("have", F.lit(TEMPER)) / of_all)
        shares.append(stored(joined))
    state = cells.withColumn("weight", F.lit(budget))
    for m, share in zip(MARGINS, shares, strict=True):
        state = state.join(share.select(F.col(m).alias("v"), F.col("share").alias(f"{m}_share")), F.col(m).eqNullSafe(F.col("v"))).drop("v")
    dead = reduce(lambda a, b: a | b, [F.col(f"{m}_share") <= 0 for m in MARGINS])
    state = stored(state.withColumn("weight", F.when(F.col("n") == 0, F.lit(budget)).when(dead, F.lit(0.0)).otherwise(F.col("weight"))))
    open_ = (F.col("n") > 0) & (F.col("weight") > 0)
    total = min(total, state.filter(open_).agg(F.sum("n")).first()[0] or 0)
    goals = []
    for m in MARGINS:
        have = stored(state.filter(open_).groupBy(m).agg(F.sum("n").cast("double").alias("have"), F.first(f"{m}_share").alias("share")))
        level, before = 0.0, -1.0
        while level != before:  # Newton's steps towards the level at which what the values can give adds up to the total; each cuts more values or ends
            before = level
            full = F.col("have") <= level * F.col("share")
            sums = have.agg(F.sum(F.when(full, F.col("have"))).alias("cut"), F.sum(F.when(~full, F.col("share"))).alias("rest")).first()
            level = (total - (sums["cut"] or 0.0)) / sums["rest"] if sums["rest"] else before
        goals.append(stored(have.select(m, F.least("have", level * F.col("share")).alias("goal"))))
    for _ in range(SPREAD_SWEEPS):
        worst = 0.0
        for m, goal in zip(MARGINS, goals, strict=True):
            sums = state.filter(open_).groupBy(m).agg(F.sum(F.when(F.col("weight") >= 1, F.col("n")).otherwise(0)).alias("cut"), F.sum(F.when(F.col("weight") < 1, F.col("n") * F.col("weight")).otherwise(0)).alias("free"))
            sums = sums.withColumnRenamed(m, "v").join(goal.withColumnRenamed(m, "w"), F.col("v").eqNullSafe(F.col("w"))).drop("w")
            more = F.when(F.col("free") > 0, (F.col("goal") - F.col("cut")) / F.col("free")).otherwise(1.0)
            factor = stored(sums.select("v", F.when(F.col("goal") > F.col("cut"), more).otherwise(F.col("goal") / (F.col("cut") + F.col("free"))).alias("factor")))
            worst = max(worst, factor.agg(F.max(F.abs(F.col("factor") - 1))).first()[0] or 0.0)
            moved = state.join(factor, F.col(m).eqNullSafe(F.col("v")), "left").withColumn("weight", F.when(open_, F.least(F.lit(1e9), F.col("weight") * F.coalesce("factor", F.lit(1.0)))).otherwise(F.col("weight")))
            last, state = state, stored(moved.drop("v", "factor"))
            discard(last, factor)
        if worst < SPREAD_TOLERANCE:
            break
    kept = F.col("n") * F.least(F.lit(1.0), F.col("weight"))
    all_kept = state.agg(F.sum(kept)).first()[0] or 1.0
    for m in MARGINS:
        reached = state.groupBy(F.col(m).alias("v")).agg((F.sum(kept) / all_kept - F.first(f"{m}_share")).alias(f"{m}_gap"))
        state = state.join(reached, F.col(m).eqNullSafe(F.col("v"))).drop("v", f"{m}_share")
    return stored(state.drop("n"))


def describe(docs: DataFrame, draw: str, seed: int = 42) -> DataFrame:
    """``docs`` with ``topic``, ``tokens`` and a number in [0, 1) from id and text, the column ``draw``."""
    number = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 53)) / float(1 << 53)
    return without(docs, *NEW).withColumns({"topic": topic(F.coalesce("text", F.lit(""))), "tokens": tokens(F.col("text")), draw: number})


NEW = ("topic", "tokens", "weight", "keep_prob", "kept", *[f"{m}_gap" for m in MARGINS])


def _mixed(docs: DataFrame, draw: str, targets: dict[str, dict] | None, budget: float, spread: bool) -> DataFrame:
    p = draw.removesuffix("draw")
    table_ = docs.groupBy(*MARGINS).agg(F.sum("tokens").alias("n"))
    counted = table_.limit(MAX_CELLS + 1).collect()
    if len(counted) > MAX_CELLS and not spread:
        raise ValueError(f"more than {MAX_CELLS} combinations of {MARGINS}: coarsen a margin, or spread the fit")
    if len(counted) > MAX_CELLS:
        fitted = _fit_spread(table_, targets, budget)
        fitted = fitted.select(*[F.col(m).alias(f"{p}{m}") for m in MARGINS], "weight", F.least(F.lit(1.0), F.col("weight")).alias("keep_prob"), *[f"{m}_gap" for m in MARGINS])
    else:
        cells = {tuple(r[m] for m in MARGINS): float(r["n"]) for r in counted}
        weight, shares = fit(cells, targets, budget)
        prob = {c: min(1.0, w) for c, w in weight.items()}
        off = gaps(cells, prob, shares)
        rows = [(*c, w, prob[c], *[off[i][v] for i, v in enumerate(c)]) for c, w in weight.items()]
        kinds = [f"{p}{m} {docs.schema[m].dataType.simpleString()}" for m in MARGINS]
        fitted = F.broadcast(docs.sparkSession.createDataFrame(rows, ", ".join([*kinds, "weight double", "keep_prob double", *[f"{m}_gap double" for m in MARGINS]])))  # at most MAX_CELLS rows
    same = reduce(lambda a, b: a & b, [F.col(m).eqNullSafe(F.col(f"{p}{m}")) for m in MARGINS])
    placed = docs.join(fitted, same).drop(*[f"{p}{m}" for m in MARGINS])
    return placed.withColumn("kept", F.col(draw) < F.col("keep_prob")).drop(draw)


def mix(docs: DataFrame, targets: dict[str, dict] | None = None, budget: float = BUDGET, seed: int = 42, spread: bool = False) -> DataFrame:
    """All columns of ``docs`` and ``topic``, ``tokens``, ``weight``, ``keep_prob``, ``kept``, ``source_gap``, ``lang_gap``, ``topic_gap``.

    ``targets`` gives shares for ``source``, ``lang`` or ``topic``; a margin
    without them gets the tempered corpus shares, a value without one share 0.
    Where a value has fewer tokens than its share of the budget, all of them
    are kept and what is missing goes to the margin's other values; a row's
    gaps are its values' reached shares, in expectation, less their targets.
    Counts cover all rows. Only the table of cells reaches the driver, a
    checked number of rows; more cells are an error, or with ``spread`` are
    fitted by DataFrame. A row is kept if its hash, a number in [0, 1) from
    id and text, is under its probability, so repeated rows fare alike and a
    rerun keeps the same. Null sources and languages are a value of their own;
    null and empty texts have no tokens and topic ``prose``; cells without any
    tokens get the budget's scale as probability. Texts of any length are
    measured whole. Columns of the new names are replaced; an empty table
    gives none.
    """
    draw = f"{free_prefix(docs)}draw"
    return _mixed(describe(docs, draw, seed), draw, targets, budget, spread)


def sample(docs: DataFrame, targets: dict[str, dict] | None = None, budget: float = BUDGET, seed: int = 42) -> DataFrame:
    """The documents that ``mix`` keeps, repeated rows all or none; columns stay as they are. Any number of cells."""
    p = free_prefix(docs)
    return mix(docs.withColumns({f"{p}{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}), targets, budget, seed, True).filter("kept").select(*[F.col(f"{p}{i}").alias(c) for i, c in enumerate(docs.columns)])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return _mixed(stored(describe(docs, "_draw").drop("text")), "_draw", None, BUDGET, True)
