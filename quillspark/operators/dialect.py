"""The dashboard dialect: the simpler rules of an interactive view of the same records.

Its lists, keys and zones differ on purpose from those of the main analyses.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import lexicon as lx, scan
from quillspark.functions.entities import lookup
from quillspark.functions.text import any_term, col, joined_lower, present, squeeze, strip, term_score

from .graph import checkpointed
from .metrics import FULL, main_metrics, top_k

# Results depend on each entry.

CATEGORIES = ["VR", "AR", "MR/XR", "Hybrid/Multi-technology"]
EXCLUSION_TERMS = ["agent-mediated", "multi-agent", "auction", "negotiation", "market mechanism", "mixed integer"]
ANCHOR_TERMS = ["hololens", "magic leap", "oculus", "htc vive", "head-mounted", " hmd "]
MR_TERMS = ["mixed reality", "extended reality", "spatial computing", "hololens", "magic leap", " xr ", " mr "]
AR_TERMS = ["augmented reality", " ar ", "smart glasses", " hud ", "mobile ar"]
VR_TERMS = ["virtual reality", " vr ", "head-mounted display", "hmd", "oculus", "htc vive", "vive", "cave system", "360 video", "360-degree video"]
PEDAGOGICAL_TERMS = [
    "learning outcome", "learning gains", "academic performance", "knowledge acquisition", "knowledge retention", "pre-test", "pretest", "post-test",
    "posttest", "control group", "experimental group", "quasi-experiment", "effect size", "student engagement", "student motivation", "cognitive load",
    "self-efficacy", "anova", "t-test", "questionnaire", "likert scale", "bloom", "constructivist", "active learning", "collaborative learning",
    "problem-based", "flipped classroom", "learning analytics", "usability study", "significant improvement", "significant difference",
]
TECHNICAL_TERMS = [
    "algorithm", "deep learning", "neural network", "machine learning", "convolutional", "object detection", "tracking", "rendering", "real-time", "latency",
    "bandwidth", "protocol", "architecture", "implementation", "framework", "system design", "sensor fusion", "point cloud", "slam", "odometry",
]
THEMATIC_TERMS = [
    "virtual reality", "augmented reality", "mixed reality", "extended reality", " vr ", " ar ", " mr ", " xr ", "hmd", "oculus", "hololens", "htc vive",
    "magic leap", "360 video", "head-mounted", "smart glasses",
]
COUNTRY_NAMES = {
    "united states": "USA", "usa": "USA", "u.s.a.": "USA", "china": "China", "p.r. china": "China", "hong kong": "China", "united kingdom": "UK", "uk": "UK",
    "england": "UK", "spain": "Spain", "taiwan": "Taiwan", "south korea": "South Korea", "korea": "South Korea", "germany": "Germany", "australia": "Australia",
    "canada": "Canada", "italy": "Italy", "japan": "Japan", "france": "France", "india": "India", "brazil": "Brazil", "netherlands": "Netherlands",
    "portugal": "Portugal", "turkey": "Turkey", "greece": "Greece", "sweden": "Sweden", "finland": "Finland", "norway": "Norway", "denmark": "Denmark",
    "poland": "Poland", "malaysia": "Malaysia", "singapore": "Singapore", "mexico": "Mexico", "iran": "Iran", "saudi arabia": "Saudi Arabia",
    "new zealand": "New Zealand",
}
KEYWORD_NAMES = {
    "virtual reality (vr)": "virtual reality", "vr": "virtual reality", "augmented reality (ar)": "augmented reality", "ar": "augmented reality",
    "elearning": "e-learning", "e learning": "e-learning", "electronic learning": "e-learning", "student": "students", "mixed reality (mr)": "mixed reality",
    "mr": "mixed reality", "extended reality (xr)": "extended reality", "xr": "extended reality", "computer aided instruction": "computer-aided instruction",
    "learning system": "learning systems", "simulation": "simulations",
}


def country(segment: Column) -> Column:
    """The listed name of the last part of an address, dots and digits at its end aside; null for any other."""
    last = F.regexp_replace(F.lower(strip(F.substring_index(segment, ",", -1))), r"[.\s0-9]+$", "")
    return F.element_at(F.create_map(*[F.lit(x) for pair in COUNTRY_NAMES.items() for x in pair]), last)


def countries(addresses: Column | str) -> Column:
    """The distinct listed countries of all ``;`` segments, in order; empty for null."""
    found = F.transform(F.split(F.coalesce(col(addresses), F.lit("")), ";"), country)
    return F.array_distinct(F.filter(found, lambda c: c.isNotNull()))


def leading_country(addresses: Column | str) -> Column:
    return country(F.substring_index(F.coalesce(col(addresses), F.lit("")), ";", 1))


def keyword(word: Column | str) -> Column:
    return lookup(KEYWORD_NAMES, F.lower(strip(col(word))))


def technology(text: Column) -> Column:
    """The class of an unpadded text: MR and XR are one; exclusion phrases hold unless hardware is named."""
    vr, ar = any_term(text, VR_TERMS), any_term(text, AR_TERMS)
    excluded = any_term(text, EXCLUSION_TERMS) & ~any_term(text, ANCHOR_TERMS)
    return F.when(~excluded, F.when(any_term(text, MR_TERMS), "MR/XR").when(vr & ar, "Hybrid/Multi-technology").when(ar, "AR").when(vr, "VR"))


def orientation(text: Column) -> Column:
    return F.when(term_score(text, PEDAGOGICAL_TERMS) >= term_score(text, TECHNICAL_TERMS), "Pedagogical").otherwise("Technical")


def title_key(title: Column | str) -> Column:
    """Lower case, then letters a-z, digits and single blanks only: accented letters go, they are not folded."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(col(title), F.lit(""))), r"(?U)[^a-z0-9\s]", ""))


def first_of_key(df: DataFrame, key: Column, row: str = "_row_id") -> DataFrame:
    """The first row of each key; rows with an empty key all stay, each a partition of its own."""
    keyed = df.withColumn("_key", key).withColumn("_alone", F.when(F.coalesce(F.col("_key"), F.lit("")) == "", F.col(row)))
    order = Window.partitionBy("_key", "_alone").orderBy(row)
    return keyed.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_key", "_alone")


Keep = Callable[[str, DataFrame], DataFrame]


def stages(df: DataFrame, row: str = "_row_id", keep: Keep = lambda name, step: step) -> list[tuple[str, DataFrame]]:
    """The lazily built table after each step; ``df`` has string columns and ``row``. The next step goes on from what ``keep`` makes of a table.

    Blank and missing values are one. A year is the integer at the start of
    its field, citations the number at the start of theirs, else 0. Where no
    record has a class, all stay (a corpus on another subject).
    """
    out: list[tuple[str, DataFrame]] = []

    def add(name: str, step: DataFrame) -> None:
        out.append((name, keep(name, step)))

    add("s0", df)
    names = [c for c in df.columns if c != row]
    clean = df.select(row, *[F.coalesce(strip(F.col(f"`{c}`")), F.lit("")).alias(c) for c in names])
    for c in ("Title", "Abstract", "Author Keywords", "Index Keywords", "Year", "DOI", "Affiliations", "Source title", "Cited by"):
        if c not in names:
            clean = clean.withColumn(c, F.lit(""))
    add("s1", clean)
    others = [c for c in clean.columns if c != row]
    add("s2", clean.groupBy(*others).agg(F.min(row).alias(row)).select(*clean.columns))
    add("s3", first_of_key(out[-1][1], F.lower(F.col("DOI")), row))
    add("s4", first_of_key(out[-1][1], title_key("Title"), row))
    add("s5", out[-1][1].filter(present("Title") & present("Year") & present("Source title")))
    add("s6", out[-1][1].filter(scan.any_of(joined_lower(lx.SCREEN_FIELDS), THEMATIC_TERMS)))
    year = F.regexp_extract("Year", r"^[+-]?[0-9]+", 0).try_cast("int")
    cites = F.regexp_extract("Cited by", r"^[+-]?[0-9]+(?:\.[0-9]+)?|^[+-]?\.[0-9]+", 0).try_cast("double")
    add("s7", out[-1][1].withColumn("Year", year).filter(F.col("Year").between(*lx.YEAR_RANGE)))
    texts = out[-1][1].withColumns({"_class": joined_lower(lx.CLASSIFICATION_FIELDS), "_screen": joined_lower(lx.SCREEN_FIELDS), "Citations": F.coalesce(cites, F.lit(0.0))})
    judged = texts.withColumns({"Tech_Category": technology(F.col("_class")), "Orientation": orientation(F.col("_screen"))}).drop("_class", "_screen")
    any_class = judged.agg(F.coalesce(F.bool_or(F.col("Tech_Category").isNotNull()), F.lit(False)).alias("_some"))  # one row
    add("s8", judged.crossJoin(F.broadcast(any_class)).filter("Tech_Category is not null or not _some").drop("_some"))
    return out


def stage_counts(df: DataFrame, row: str = "_row_id") -> DataFrame:
    """``(stage_no, stage, records)``: two steps are written and read again, so that none before them is computed for each later count; the counts between read keys only."""
    steps = stages(df, row, lambda name, step: checkpointed(step) if name in ("s2", "s6") else step)
    counts = [t.agg(F.count(F.lit(1)).alias("records")).select(F.lit(n).alias("stage_no"), F.lit(name).alias("stage"), "records") for n, (name, t) in enumerate(steps)]
    return reduce(DataFrame.unionByName, counts)


def cards(df: DataFrame, category: str = "Tech_Category", cites: str = "Citations", categories: list[str] | None = None) -> DataFrame:
    """One row for all records and one for each class, zero where it is absent: records, citations, share in percent."""
    categories = CATEGORIES if categories is None else categories
    sums = [F.sum((F.col(category) == c).cast("long")).alias(f"n{i}") for i, c in enumerate(categories)]
    paid = [F.sum(F.when(F.col(category) == c, F.col(cites)).otherwise(0.0)).alias(f"c{i}") for i, c in enumerate(categories)]
    one = df.agg(F.count(F.lit(1)).alias("n"), F.sum(cites).alias("c"), *sums, *paid)
    zero = lambda name: F.coalesce(name, F.lit(0))
    card = lambda label, n, c: F.struct(F.lit(label).alias("card"), zero(n).cast("long").alias("records"), zero(c).cast("double").alias("citations"), F.when(F.col("n") > 0, F.round(100.0 * zero(n) / F.col("n"), 1)).otherwise(0.0).alias("share"))
    return one.select(F.inline(F.array(card("All", "n", "c"), *[card(x, f"n{i}", f"c{i}") for i, x in enumerate(categories)])))


def bradford(df: DataFrame, source: str) -> DataFrame:
    """Sources and documents of three zones, by the documents up to and including a source: a source over a third's end is in the next zone.

    As in the main analysis the window sees distinct source sizes, not sources.
    """
    sizes = df.filter(present(F.col(source).cast("string"))).groupBy(source).agg(F.count(F.lit(1)).alias("size"))
    runs = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("sources")).withColumn("articles", F.col("size") * F.col("sources"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("size"))
    runs = runs.withColumn("total", F.sum("articles").over(Window.partitionBy(F.lit(0)))).withColumn("before", F.sum("articles").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("articles"))
    within = lambda z: F.least("sources", F.greatest(F.lit(0), F.floor((F.lit(z) * F.col("total") - 3 * F.col("before")) / (3 * F.col("size"))))).cast("long")
    cut = runs.withColumn("z1", within(1)).withColumn("z2", within(2) - F.col("z1")).withColumn("z3", F.col("sources") - F.col("z1") - F.col("z2"))
    zones = [F.struct(F.lit(z).alias("zone"), F.coalesce(F.sum(f"z{z}"), F.lit(0)).alias("sources"), F.coalesce(F.sum(F.col(f"z{z}") * F.col("size")), F.lit(0)).alias("documents")) for z in (1, 2, 3)]
    return cut.agg(F.array(*zones).alias("z")).select(F.inline("z"))


def collaboration(df: DataFrame, leader: str, n_countries: Column, category: str, categories: list[str] | None = None, k: int = 12) -> DataFrame:
    """Documents by leader, class and status for the k largest leaders, one column each; documents without a leader go, a single country is SCP."""
    categories = CATEGORIES if categories is None else categories
    known = df.filter(F.col(leader).isNotNull()).withColumn("_mcp", n_countries > 1)
    cells = [F.sum(((F.col(category) == c) & (F.col("_mcp") == (s == "MCP"))).cast("long")).alias(f"{c}_{s}") for c in categories for s in ("SCP", "MCP")]
    counted = known.groupBy(F.col(leader).alias("country")).agg(*cells, F.count(F.lit(1)).alias("total"))
    return top_k(counted, k, [F.desc("total"), F.asc("country")]).drop("rank").fillna(0)


#: Header of the downloaded table, fixed values.
DOWNLOAD_HEADER = ["Category", "N", "Total Citations", "H-index", "CAGR", "AC", "NCP", "%Cited", "CCP", "First Year", "Peak Year"]


def download(df: DataFrame, category: str = "Tech_Category", cites: str = "Citations", categories: list[str] | None = None) -> DataFrame:
    """The table of key metrics as it is downloaded, all text: a row for the corpus and one for each class that has records, in the classes' order."""
    names = [FULL, *(CATEGORIES if categories is None else categories)]
    found = main_metrics(df.withColumn(category, F.when(F.col(category).isin(names[1:]), F.col(category))), category, "Year", cites)
    two = lambda c: F.format_string("%.2f", F.col(c))
    several = F.col("last_year") > F.col("first_year")
    shown = {
        "Category": F.col(category), "N": F.format_number("documents", 0), "Total Citations": F.call_function("format_number", "tc", F.lit("#,##0.###")), "H-index": F.col("h_index").cast("string"),
        "CAGR": F.when(several, F.concat(two("growth"), F.lit("%"))).otherwise("—"), "AC": two("ac"), "NCP": F.format_number("ncp", 0), "%Cited": F.concat(F.format_string("%.1f", F.col("pct_cited")), F.lit("%")),
        "CCP": F.when(F.col("ncp") > 0, two("ccp")).otherwise("0"), "First Year": F.col("first_year").cast("string"), "Peak Year": F.col("peak_year").cast("string"),
    }
    at = F.array_position(F.array(*map(F.lit, names)), F.col(category))
    return found.join(df.groupBy(category).agg(F.max("Year").alias("last_year")).unionByName(df.agg(F.lit(FULL).alias(category), F.max("Year").alias("last_year"))), category).orderBy(at).select(*[c.alias(n) for n, c in shown.items()])
