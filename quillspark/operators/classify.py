"""Screens and classes of records, with the evidence for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import lexicon as lx
from quillspark.functions import scan
from quillspark.functions.text import any_term, joined_lower, number, present, term_score


def essential(df: DataFrame, fields: list[str] | None = None, year: str = "Year") -> DataFrame:
    """Rows with all essential fields and a numeric year, which becomes an integer; a missing column is an error."""
    fields = lx.ESSENTIAL_FIELDS if fields is None else fields
    if absent := [f for f in fields if f not in df.columns]:
        raise ValueError(f"essential columns are absent: {absent}")
    for f in fields:
        df = df.filter(present(F.col(f).cast("string")))
    return df.withColumn(year, number(year).cast("int")).filter(F.col(year).isNotNull())


def thematic(df: DataFrame, fields: list[str], terms: list[str] | None = None) -> DataFrame:
    """Rows whose joined fields hold any of the terms."""
    return df.filter(scan.any_of(joined_lower(fields, padded=True), lx.THEMATIC_TERMS if terms is None else terms))


def within_years(df: DataFrame, year: str = "Year", first: int = lx.YEAR_RANGE[0], last: int = lx.YEAR_RANGE[1]) -> DataFrame:
    return df.filter(F.col(year).between(first, last))


def technology(text: Column, vr: list[str] = lx.VR_TERMS, ar: list[str] = lx.AR_TERMS, mr: list[str] = lx.MR_TERMS, xr: list[str] = lx.XR_TERMS) -> Column:
    """The class by priority: MR, XR, both VR and AR, AR, VR; null without a signal."""
    is_vr, is_ar = any_term(text, vr), any_term(text, ar)
    return F.when(any_term(text, mr), "MR").when(any_term(text, xr), "XR").when(is_vr & is_ar, "Hybrid/Multi-technology").when(is_ar, "AR").when(is_vr, "VR")


def orientation(text: Column, technical: list[str] = lx.TECHNICAL_TERMS, pedagogical: list[str] = lx.PEDAGOGICAL_TERMS) -> Column:
    """Pedagogical unless more technical terms occur."""
    return F.when(term_score(text, pedagogical) >= term_score(text, technical), "Pedagogical").otherwise("Technical")


def texts(df: DataFrame, padded: bool) -> DataFrame:
    """``_class_text`` of all classification fields and ``_screen_text`` without the index keywords, each built once."""
    known = lambda names: [f for f in names if f in df.columns]
    return df.withColumns({"_class_text": joined_lower(known(lx.CLASSIFICATION_FIELDS), padded), "_screen_text": joined_lower(known(lx.SCREEN_FIELDS), padded)})


def classified(df: DataFrame) -> DataFrame:
    """``Tech_Category`` and, where there is one, ``Orientation``, which does not read the index keywords.

    Each of the two texts is read once, for the terms of all lists together.
    """
    signals = [*lx.VR_TERMS, *lx.AR_TERMS, *lx.MR_TERMS, *lx.XR_TERMS]
    first = lambda found: (
        F.when(scan.has_any(found, lx.MR_TERMS), "MR").when(scan.has_any(found, lx.XR_TERMS), "XR")
        .when(scan.has_any(found, lx.VR_TERMS) & scan.has_any(found, lx.AR_TERMS), "Hybrid/Multi-technology").when(scan.has_any(found, lx.AR_TERMS), "AR").when(scan.has_any(found, lx.VR_TERMS), "VR")
    )
    leans = lambda found: F.when(F.size(scan.among(found, lx.PEDAGOGICAL_TERMS)) >= F.size(scan.among(found, lx.TECHNICAL_TERMS)), "Pedagogical").otherwise("Technical")
    placed = texts(df, padded=True).withColumn("Tech_Category", scan.bound(scan.found_terms("_class_text", signals), first))
    leaning = scan.bound(scan.found_terms("_screen_text", [*lx.PEDAGOGICAL_TERMS, *lx.TECHNICAL_TERMS]), leans)
    return placed.withColumn("Orientation", F.when(F.col("Tech_Category").isNotNull(), leaning)).drop("_class_text", "_screen_text")


def screened(df: DataFrame, fields: list[str] = lx.SCREEN_FIELDS) -> DataFrame:
    """The education screen: cues with labels, the machine-learning safeguard, status and disposition.

    A clinical cue is reported and never vetoes. Where a machine-learning
    phrase occurs, generic learning labels alone are no cue.
    """
    substantive = [p for k, p in lx.EDUCATION_PATTERNS.items() if k not in lx.GENERIC_LEARNING_LABELS]
    every = dict.fromkeys([*lx.EDUCATION_PATTERNS.values(), *lx.CLINICAL_PATTERNS.values(), *lx.MACHINE_LEARNING_PATTERNS])
    found, text = F.col("_cues"), joined_lower([f for f in fields if f in df.columns])
    any_of = lambda patterns: scan.has_any(found, patterns)
    labels = lambda patterns: F.concat_ws("; ", *[F.when(F.array_contains(found, p), F.lit(label)) for label, p in patterns.items()])
    counts = any_of(substantive) | (any_of(lx.EDUCATION_PATTERNS.values()) & ~any_of(lx.MACHINE_LEARNING_PATTERNS))
    out = df.withColumn("_cues", scan.found_patterns(text, every)).withColumn("Has_Education_Cue", counts)
    cue = F.col("Has_Education_Cue")
    return out.withColumns(
        {
            "Has_Clinical_Use_Cue": any_of(lx.CLINICAL_PATTERNS.values()),
            "Matched_Education_Cues": F.when(cue, labels(lx.EDUCATION_PATTERNS)).otherwise(F.lit("")),
            "Matched_Clinical_Use_Cues": labels(lx.CLINICAL_PATTERNS),
            "Education_Screen_Status": F.when(cue, lx.SCREEN_STATUS[True]).otherwise(lx.SCREEN_STATUS[False]),
            "Education_Screen_Disposition": F.when(cue, "include_algorithm").otherwise("exclude_algorithm"),
            "Education_Screen_Fields": F.lit(", ".join(fields)),
        }
    ).drop("_cues")


def classification_trace(df: DataFrame) -> DataFrame:
    """Per record: the matched terms of every list. Texts are not padded here, so a padded term at either end is no match."""
    signals = {
        "Matched_VR_terms": lx.VR_TERMS, "Matched_AR_terms": lx.AR_TERMS, "Matched_MR_terms": lx.MR_TERMS, "Matched_XR_terms": lx.XR_TERMS,
        "Matched_Exclusion_terms": lx.EXCLUSION_TERMS, "Matched_Hardware_rescue_terms": lx.HARDWARE_TERMS,
    }
    leanings = {"Matched_Technical_terms": lx.TECHNICAL_TERMS, "Matched_Pedagogical_terms": lx.PEDAGOGICAL_TERMS}
    both = (("_class_text", signals), ("_screen_text", leanings))
    hits = {text: scan.found_terms(text, [t for terms in lists.values() for t in terms]) for text, lists in both}
    shown = lambda text, terms: F.array_join(F.transform(scan.among(F.col(text), terms), lambda term: F.trim(term)), "; ")
    traced = texts(df, padded=False).withColumns(hits).withColumns({n: shown(text, terms) for text, lists in both for n, terms in lists.items()})
    return traced.drop("_class_text", "_screen_text")


def scope_signals(text: Column) -> dict[str, Column]:
    return {"Education_signal": any_term(text, lx.EDUCATION_SIGNALS), "Health_or_clinical_signal": any_term(text, lx.HEALTH_SIGNALS)}


def class_report(df: DataFrame, category: str = "Tech_Category", orientation: str = "Orientation") -> DataFrame:
    """``(place, section, label, records, percent)``: all records, those with and without a class, each class, and the orientations of classified ones; from one aggregate, zero where nothing is."""
    has = F.col(category).isNotNull()
    lines = [("records", "Total records", F.lit(True), "all"), ("records", "Classified", has, "all"), ("records", "Excluded/Unknown", ~has, "all")]
    lines += [("technology", c, F.col(category) == c, "all") for c in lx.CATEGORIES]
    lines += [("orientation", o, has & (F.col(orientation) == o), "classified") for o in ("Technical", "Pedagogical")]
    counts = df.agg(*[F.count_if(F.coalesce(condition, F.lit(False))).alias(f"n{i}") for i, (_, _, condition, _) in enumerate(lines)])
    of = {"all": F.col("n0"), "classified": F.col("n1")}
    rows = [F.struct(F.lit(i).alias("place"), F.lit(section).alias("section"), F.lit(label).alias("label"), F.col(f"n{i}").alias("records"), F.when(of[base] > 0, F.round(100.0 * F.col(f"n{i}") / of[base], 1)).otherwise(0.0).alias("percent")) for i, (section, label, _, base) in enumerate(lines)]
    return counts.select(F.inline(F.array(*rows)))
