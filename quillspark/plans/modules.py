"""The analysis modules: each gives its result tables, with their published names and headers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import entities, lexicon as lx
from quillspark.functions.text import joined_lower, present
from quillspark.operators import classify, collab, graph, keywords, metrics
from quillspark.plans import corpus

TEXT_AND_KEYS = ["EID", "Title", "Year"]

# The published tables depend on each of these thresholds, names and headers, those in the modules below included.

#: Minimum documents and links of the networks; the first of each list's baseline is what is tabulated.
COCITATION, COCITATION_GRID = (15, 2), [(10, 2), (15, 2), (20, 2), (30, 3), (15, 3), (15, 5)]
NETWORKS = {
    "Keywords": ((25, 8), [(15, 5), (20, 6), (25, 8), (30, 10), (40, 12)]),
    "Authors": ((8, 3), [(5, 2), (8, 3), (12, 4), (15, 5)]),
}
INSTITUTION_NETWORK = (8, 1, 60)
#: Institutions that the table shows besides the twenty largest.
SHOWN_INSTITUTIONS = [
    "University of Toronto", "University of Washington", "Harvard Medical School", "Stanford University", "Massachusetts Institute of Technology (MIT)",
    "Imperial College London", "Københavns Universitet", "Rigshospitalet",
]


@dataclass(frozen=True)
class Table:
    """A result: ``order`` sorts it; tables that grow with the corpus are not ``small`` and are written in parts."""

    rows: DataFrame
    order: tuple[Column | str, ...] = ()
    small: bool = True
    markdown: bool = False


Module = Callable[[DataFrame], dict[str, Table]]


def prepared(df: DataFrame) -> DataFrame:
    """The classified corpus with ``cites``, ``countries``, ``leader`` and ``collab``; absent optional columns are null."""
    wanted = ["Author Keywords", "Index Keywords", "Authors", "Affiliations", "References", "Cited by", "Citations"]
    df = df.withColumns({c: F.lit(None).cast("string") for c in wanted if c not in df.columns})
    cites = F.coalesce(F.coalesce("Cited by", "Citations").try_cast("double"), F.lit(0.0))
    if "_ord" not in df.columns:
        df = df.withColumn("_ord", F.col("_row_id"))
    placed = df.withColumns({"cites": cites, "countries": entities.countries("Affiliations"), "leader": entities.leading_country("Affiliations")})
    return placed.withColumn("collab", collab.status(F.size("countries")))


def _renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of ``names`` (header -> column), in order."""
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in names.items()])


def _at(values: list[str], column: str) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))


def a1(df: DataFrame) -> dict[str, Table]:
    stats = metrics.yearly(df, "Tech_Category", "Year", "cites", *lx.YEAR_RANGE, groups=lx.CATEGORIES)
    out = _renamed(stats, {"Category": "Tech_Category", "Year": "year", "N": "n", "TC": "tc", "Impact": "impact"})
    return {"table_A1_yearly_stats": Table(out, (_at(lx.CATEGORIES, "Category"), "Year"))}


def a2(df: DataFrame) -> dict[str, Table]:
    counts = df.filter("Year is not null and Tech_Category is not null and Orientation is not null").groupBy("Year", "Tech_Category", "Orientation").agg(F.count(F.lit(1)).alias("Count"))
    return {"table_A2_orientation_counts": Table(counts, ("Year", "Tech_Category", "Orientation"))}


def a2b(df: DataFrame) -> dict[str, Table]:
    """The data of the four panels; drawing is left to others."""
    counts = df.groupBy(F.col("Tech_Category").alias("Category"), F.col("Year").cast("long").alias("Year")).pivot("Orientation", ["Technical", "Pedagogical"]).count().fillna(0)
    marks = df.sparkSession.createDataFrame([(c, y, t) for c, v in lx.MILESTONES.items() for y, t in v], "Category string, Year int, Milestone string")
    return {"data_A2b_orientation_by_year": Table(counts, ("Category", "Year")), "data_A2b_milestones": Table(marks, ("Category", "Year"))}


def a3(df: DataFrame) -> dict[str, Table]:
    names = "Author full names" if "Author full names" in df.columns else "Authors"
    label = entities.display_institution(F.trim(F.substring_index("Affiliations", ";", 1)))
    rows = df.select("_ord", F.col("Tech_Category").alias("Category"), "cites", label.alias("Affiliation"), F.explode(entities.author_names(names)).alias("Author"))
    stats = rows.groupBy("Category", "Author").agg(F.count(F.lit(1)).alias("Pubs"), F.sum("cites").cast("long").alias("Citations"))
    home = metrics.majority(rows, ["Author"], "Affiliation", "_ord").drop("n")
    out = stats.join(metrics.h_index(rows, ["Category", "Author"], "cites"), ["Category", "Author"]).join(home, "Author", "left")
    out = out.select("Author", F.coalesce("Affiliation", F.lit("Unknown")).alias("Affiliation"), "Pubs", "Citations", "h_index", "Category")
    return {"table_A3_author_stats": Table(out, small=False)}


def a4(df: DataFrame) -> dict[str, Table]:
    shares = _renamed(
        collab.contributions(df, "countries", "leader").withColumn("percent", F.round("percent", 2)),
        {"Country": "country", "Articles with any affiliation in country": "documents", "Articles assigned by first affiliation": "led", "Percent of corpus (any affiliation)": "percent"},
    )
    wide = collab.pivot(df, "leader", "Tech_Category", "collab", lx.CATEGORIES, k=12).withColumnsRenamed({"country": "Country", "total_scp": "Total_SCP", "total_mcp": "Total_MCP", "total": "Total"})
    one = _renamed(
        collab.summary(df, "leader", "collab"),
        {
            "Global_SCP": "scp", "Global_MCP": "mcp", "Corpus_Total": "total", "Country_Identifiable": "identifiable", "Shown_Top12": "shown",
            "Shown_Coverage_of_Country_Identifiable": "coverage", "Unassigned_or_not_shown": "not_shown", "Unresolved_collaboration_status": "unresolved",
        },
    )
    rates = _renamed(
        collab.mcp_rates(df.filter("leader is not null"), ["leader", "Tech_Category"], "collab"),
        {"Country": "leader", "Category": "Tech_Category", "Documents": "documents", "MCP documents": "mcp", "MCP proportion": "proportion", "Wilson 95% CI lower": "low", "Wilson 95% CI upper": "high"},
    ).withColumn("Formula", F.lit("MCP = >1 distinct parsed country; Wilson score interval; n>=10"))
    return {
        "table_A4_country_contributions": Table(shares, (F.desc("Articles with any affiliation in country"), "Country")),
        "table_A4_country_collab": Table(wide, (F.desc("Total"), "Country")),
        "table_A4_global_collab_summary": Table(one),
        "table_A4_scp_mcp_rates_ci": Table(rates, ("Country", "Category")),
    }


def a4b(df: DataFrame) -> dict[str, Table]:
    wide = collab.pivot(df, "leader", "Tech_Category", "collab", lx.CATEGORIES, only=lx.COUNTRY_ORDER)
    cells = {f"{c}|{s}": f"{c}_{s}" for c in lx.CATEGORIES for s in ("SCP", "MCP")}
    out = _renamed(wide, {"_leader": "country"} | cells | {"Total_SCP": "total_scp", "Total_MCP": "total_mcp", "Total": "total"})
    return {"table_A4b_country_collab": Table(out, (_at(lx.COUNTRY_ORDER, "_leader"),))}


def a5(df: DataFrame) -> dict[str, Table]:
    zones = metrics.bradford(df.withColumn("_source", F.trim("Source title")), "Tech_Category", "_source").withColumnRenamed("Tech_Category", "category")
    return {"table_A5_bradford_zones": Table(zones, (_at([metrics.FULL, *lx.CATEGORIES], "category"),))}


def _mapped(column: str, table: dict[str, str]) -> Column:
    return F.transform(entities.keywords(column), lambda k: entities.lookup(table, k))


def cleaned_keywords(df: DataFrame) -> Column:
    """Author keywords by the fixed table, then by merged spellings, each once a document."""
    merged = keywords.merged_spellings(df, _mapped("Author Keywords", lx.KEYWORD_MAP))
    return entities.mapped_keywords(entities.keywords("Author Keywords"), merged=merged)


def a5b(df: DataFrame) -> dict[str, Table]:
    items = df.select("_row_id", "_ord", F.posexplode(cleaned_keywords(df)).alias("at", "keyword")).withColumn("seen", F.struct("_ord", "at"))
    cells = graph.matrix(items, "_row_id", "keyword", 10, "seen")
    top = [r["row"] for r in cells.filter(F.col("row") == F.col("column")).orderBy(F.desc("n"), "row").collect()]  # ten names
    if not top:
        return {"table_A5b_cooccurrence_matrix": Table(cells)}
    wide = cells.groupBy(F.col("row").alias("keyword")).pivot("column", top).agg(F.first("n")).fillna(0)
    return {"table_A5b_cooccurrence_matrix": Table(wide, (_at(top, "keyword"),))}


def a5c(df: DataFrame) -> dict[str, Table]:
    words = cleaned_keywords(df)
    whole = keywords.top_keywords(df, words, 10, order="_ord")
    each = keywords.top_keywords(df, words, 10, ["Tech_Category"], "_ord")
    return {
        "table_A5c_global_keywords": Table(_renamed(whole, {"Keyword": "keyword", "Count": "n"}), (F.desc("Count"), "Keyword")),
        "table_A5c_category_keywords": Table(_renamed(each, {"category": "Tech_Category", "keyword": "keyword", "count": "n"}), (_at(lx.CATEGORIES, "category"), F.desc("count"), "keyword")),
    }


def a6(df: DataFrame) -> dict[str, Table]:
    names = [metrics.FULL, *lx.CATEGORIES]
    found = metrics.main_metrics(df, "Tech_Category", "Year", "cites").withColumns(
        {"tc": F.col("tc").cast("long"), "growth": F.round("growth", 2), "ac": F.round("ac", 2), "ccp": F.round("ccp", 2), "pct_cited": F.concat(F.round("pct_cited", 1).cast("string"), F.lit("%"))}
    )
    headers = {
        "Documents (N)": "documents", "Total Citations (TC)": "tc", "H-index": "h_index", "Annual Growth Rate %": "growth", "Avg Citations/Doc (AC)": "ac",
        "Cited Pubs (NCP)": "ncp", "% Cited": "pct_cited", "Cit/Cited Doc (CCP)": "ccp", "First Year": "first_year", "Peak Year": "peak_year",
    }
    spine = df.sparkSession.createDataFrame([(n,) for n in names], "Tech_Category string")
    out = spine.join(found, "Tech_Category", "left").select(F.col("Tech_Category").alias("Category"), *[F.coalesce(F.col(c).cast("string"), F.lit("N/A")).alias(h) for h, c in headers.items()])
    return {"table_A6_bibliometric_main": Table(out, (_at(names, "Category"),), markdown=True)}


def _compared(df: DataFrame) -> DataFrame:
    """The ten first author keywords (once a document) beside the ten first index keywords (every occurrence), by rank."""
    return keywords.rank_aligned(keywords.top_keywords(df, cleaned_keywords(df), 10), keywords.top_keywords(df, _mapped("Index Keywords", lx.INDEX_KEYWORD_MAP), 10))


def a7(df: DataFrame) -> dict[str, Table]:
    out = _compared(df).orderBy("rank").select(F.col("left_keyword").alias("Author Keywords"), F.col("left_n").alias("Freq (Auth)"), F.col("right_keyword").alias("Index Keywords"), F.col("right_n").alias("Freq (Index)"))
    return {"table_A7_keywords_comparison": Table(out, markdown=True)}


def network_items(df: DataFrame) -> dict[str, DataFrame]:
    """``(_row_id, item)`` of the three networks of a record's own lists, repeats included."""
    lists = {"Keywords": entities.keywords("Author Keywords"), "Authors": F.filter(entities.items("Authors"), lambda a: F.length(a) > 2), "Institutions": entities.institutions("Affiliations")}
    return {n: df.select("_row_id", F.explode(c).alias("item")) for n, c in lists.items()}


DRAWN_NETWORKS = {n: (*NETWORKS[n][0], 70) for n in NETWORKS} | {"Institutions": INSTITUTION_NETWORK}


def network_lines(items: dict[str, DataFrame], limits: dict[str, tuple[int, int, int]] | None = None) -> DataFrame:
    """The edges of each network at its limits: least frequency, least links, most nodes."""
    limits = DRAWN_NETWORKS if limits is None else limits
    lines = [graph.network(items[n], "_row_id", "item", *limits[n], distinct=False)[1].withColumn("network", F.lit(n)) for n in limits]
    return reduce(DataFrame.unionByName, lines)


def a8(df: DataFrame) -> dict[str, Table]:
    cited = df.select("_row_id", F.explode(entities.cited_authors("References")).alias("item"))
    nodes, edges = graph.network(cited, "_row_id", "item", *COCITATION)
    edges = graph.checkpointed(edges)
    labels = graph.louvain(edges)
    linked = graph.degrees(edges).select("id", F.lit(True).alias("linked"))
    node_table = nodes.join(labels, "id", "left").join(linked, "id", "left").select(
        F.col("id").alias("Author"), F.col("freq").alias("Citing documents"), F.col("cluster").alias("Louvain cluster"), F.coalesce("linked", F.lit(False)).alias("Connected at plotted threshold")
    )
    edge_table = edges.join(labels.withColumnRenamed("id", "src"), "src", "left").select(F.col("src").alias("Author 1"), F.col("dst").alias("Author 2"), F.col("weight").alias("Co-citing documents"), F.col("cluster").alias("Cluster"))
    sizes = graph.sensitivity(cited, "_row_id", "item", COCITATION_GRID).drop("density")
    grid = sizes.join(graph.community_grid(cited, "_row_id", "item", COCITATION_GRID, COCITATION), ["min_freq", "min_edge"]).withColumn("ari", F.round("ari", 4))
    grid = _renamed(
        grid,
        {
            "Minimum citing-document frequency": "min_freq", "Minimum co-citing documents": "min_edge", "Authors (including isolates)": "nodes", "Linked authors": "linked",
            "Links": "edges", "Clusters": "communities", "Modularity": "modularity", "ARI vs baseline": "ari",
        },
    )
    items = network_items(df)
    measured = [graph.largest_component_grid(items[n], "_row_id", "item", g, base).withColumn("Network", F.lit(n)) for n, (base, g) in NETWORKS.items()]
    networks = _renamed(
        reduce(DataFrame.unionByName, measured).withColumn("ari", F.round("ari", 4)),
        {
            "Network": "Network", "Minimum document frequency": "min_freq", "Minimum co-occurrence": "min_edge", "Nodes (largest component)": "nodes",
            "Edges (largest component)": "edges", "Density": "density", "Communities": "communities", "Modularity": "modularity", "ARI vs baseline": "ari",
        },
    )
    return {
        "table_A8_author_cocitation_nodes": Table(node_table, (F.desc("Citing documents"), "Author")),
        "table_A8_author_cocitation_edges": Table(edge_table, small=False),
        "table_A8_author_cocitation_sensitivity": Table(grid, ("Minimum citing-document frequency", "Minimum co-citing documents")),
        "table_A8_network_sensitivity": Table(networks, (F.desc("Network"), "Minimum document frequency")),
        "data_A8_network_edges": Table(network_lines(items), ("network", F.desc("weight"), "src", "dst")),
    }


def institution_table(df: DataFrame) -> DataFrame:
    """Documents and citations of the twenty largest institutions and of those always shown; a record counts once for each of its institutions."""
    placed = df.select("cites", F.explode(entities.institutions("Affiliations")).alias("Institution")).groupBy("Institution").agg(F.count(F.lit(1)).alias("Documents"), F.sum("cites").alias("tc"))
    most = placed.orderBy(F.desc("Documents"), F.desc("tc"), "Institution").limit(20)
    shown = most.unionByName(placed.filter(F.col("Institution").isin(SHOWN_INSTITUTIONS))).distinct()
    return shown.select("Institution", "Documents", F.col("tc").cast("long").alias("Total Citations"), F.round(F.col("tc") / F.col("Documents"), 2).alias("CPP"))


def a9(df: DataFrame) -> dict[str, Table]:
    institutions = institution_table(df)

    named = df.filter(present("Source title")).select(F.col("Source title").alias("Source"), "cites")
    stats = named.groupBy("Source").agg(F.count(F.lit(1)).alias("Articles"), F.sum("cites").alias("tc")).orderBy(F.desc("Articles"), F.desc("tc"), "Source").limit(20)
    h = metrics.h_index(named.join(stats.select("Source"), "Source", "left_semi"), ["Source"], "cites")
    none = F.lit(None).cast("string")
    sources = stats.join(h, "Source").select("Source", "Articles", F.col("tc").cast("long").alias("Total Citations"), F.round(F.col("tc") / F.col("Articles"), 2).alias("CPP"), F.col("h_index").alias("H-index"), none.alias("Q"), none.alias("SJR"))

    ranked = _compared(df)
    words = _renamed(ranked, {"Rank": "rank", "Author Keywords": "left_keyword", "Author Freq.": "left_n", "Index Keywords": "right_keyword", "Index Freq.": "right_n"})

    led = df.filter("leader is not null")
    bounds = metrics.rca_bootstrap(led, "leader", "Tech_Category")
    largest = bounds.select("leader", "row_n").distinct().orderBy(F.desc("row_n"), "leader").limit(15).select("leader")
    shares = graph.checkpointed(bounds.join(largest, "leader", "left_semi"))
    wide = shares.groupBy(F.col("leader").alias("Country"), "row_n").pivot("Tech_Category", lx.CATEGORIES).agg(F.first("rca")).fillna(0.0)
    intervals = _renamed(
        shares.withColumn("least", F.lit(10)),
        {
            "Country": "leader", "Category": "Tech_Category", "Country documents": "row_n", "Country-category documents": "n", "RCA": "rca", "Bootstrap 95% CI lower": "low",
            "Bootstrap 95% CI upper": "high", "Bootstrap replicates": "replicates", "Minimum country N": "least",
        },
    )
    donuts = collab.residual(df.filter("collab <> 'Unresolved'"), "leader", "collab")
    return {
        "table_A9_institutions": Table(institutions, (F.desc("Documents"), F.desc("Total Citations"), "Institution")),
        "table_A9_sources": Table(sources, (F.desc("Articles"), F.desc("Total Citations"), "Source")),
        "table_A9_keywords": Table(words, ("Rank",)),
        "table_A9_rca": Table(wide.orderBy(F.desc("row_n"), "Country").drop("row_n")),
        "table_A9_rca_confidence_intervals": Table(intervals, (F.desc("Country documents"), "Country", _at(lx.CATEGORIES, "Category"))),
        "data_A9_collaboration_shares": Table(donuts, ("collab", F.desc("n"), "country")),
    }


MODULES: dict[str, Module] = {"a1": a1, "a2": a2, "a2b": a2b, "a3": a3, "a4": a4, "a4b": a4b, "a5": a5, "a5b": a5b, "a5c": a5c, "a6": a6, "a7": a7, "a8": a8, "a9": a9}


# Audits, which always run


def a0(stages: DataFrame) -> dict[str, Table]:
    """The audit of ``corpus.audit`` as the pipeline report and as the table of stages."""
    noted = stages.withColumn("note", entities.lookup(corpus.CRITERIA, F.col("stage")))
    report = noted.select("stage", "records", "note", F.col("removed").alias("dropped"), F.when(F.col("stage") == "6_thematic_screen", F.col("removed")).alias("dropped_thematic"), "stage_no")
    table = _renamed(noted, {"Stage": "stage", "Records before": "before", "Removed": "removed", "Records after": "records", "Criterion": "note", "stage_no": "stage_no"})
    by_stage = lambda df: df.orderBy("stage_no").drop("stage_no")
    return {"pipeline_report": Table(by_stage(report)), "table_A0_pipeline_audit": Table(by_stage(table), markdown=True)}


def a10(included: DataFrame) -> dict[str, Table]:
    """Evidence, worksheet and counts of the records that the education screen includes, unclassified ones too."""
    known = lambda names, df=included: [c for c in names if c in df.columns]
    trace = classify.classification_trace(included)
    matched = [c for c in trace.columns if c.startswith("Matched_") and c.endswith("_terms")]
    trace = trace.select(*known([*TEXT_AND_KEYS, "Tech_Category", "Orientation"]), *matched)
    sample = metrics.stratified(included.filter("Tech_Category is not null"), "Tech_Category", F.struct(F.xxhash64(F.lit(20260929), "_row_id"), "_row_id"), 50)
    sample = sample.dropDuplicates(["EID" if "EID" in included.columns else "Title"])
    sheet = sample.select(*known([*TEXT_AND_KEYS, "Abstract", "Author Keywords", "Index Keywords"]), F.col("Tech_Category").alias("Automated_Tech_Category"), F.col("Orientation").alias("Automated_Orientation"))
    blanks = ["Rater1_Tech_Category", "Rater2_Tech_Category", "Adjudicated_Tech_Category", "Rater1_Orientation", "Rater2_Orientation", "Adjudicated_Orientation", "Coding_Rationale"]
    counts = included.groupBy("Tech_Category", "Orientation").agg(F.count(F.lit(1)).alias("Documents"))
    signals = classify.scope_signals(F.col("_s"))
    flags = included.select(joined_lower(known(lx.SCREEN_FIELDS)).alias("_s")).agg(*[F.struct(F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias("Documents"), F.round(100 * F.avg(c.cast("double")), 2).alias("p")).alias(n) for n, c in signals.items()])
    rule = "Any listed term in Title, Abstract, or Author Keywords; non-exclusive descriptive flag"
    scope = flags.select(F.inline(F.array(*[F.struct(F.lit(label).alias("Indicator"), F.col(f"{n}.Documents").alias("Documents"), F.col(f"{n}.p").alias("Percent_of_corpus"), F.lit(rule).alias("Rule")) for n, label in zip(signals, ("Education signal", "Health/clinical signal"), strict=True)])))
    return {
        "table_A10_classification_trace": Table(trace, small=False),
        "table_A10_human_validation_worksheet": Table(sheet.withColumns({b: F.lit("") for b in blanks}), ("Automated_Tech_Category", "Title")),
        "table_A10_classifier_counts": Table(counts, (F.asc_nulls_last("Tech_Category"), "Orientation")),
        "table_A10_scope_signal_counts": Table(scope),
    }


def a11(judged: DataFrame) -> dict[str, Table]:
    """Trace, counts and rules of the education screen over all records that it saw."""
    flags = ["Education_Screen_Disposition", "Has_Education_Cue", "Has_Clinical_Use_Cue"]
    shown = [*TEXT_AND_KEYS, "Source title", "Tech_Category", "Education_Screen_Status", *flags, "Matched_Education_Cues", "Matched_Clinical_Use_Cues", *lx.SCREEN_FIELDS]
    counts = metrics.percent_of_total(judged.groupBy(*flags).agg(F.count(F.lit(1)).alias("Documents")), "Documents", "Percent of screened corpus")
    rules = [
        ("Input fields", "; ".join(lx.SCREEN_FIELDS)),
        ("Education cue dictionary", "; ".join(lx.EDUCATION_PATTERNS)),
        ("Clinical-use dictionary (audit only)", "; ".join(lx.CLINICAL_PATTERNS)),
        ("Computational-language safeguard", "; ".join(lx.MACHINE_LEARNING_PATTERNS)),
        ("Include", "An education or training cue in an input field; a clinical-use cue does not matter."),
        ("Exclude", "No education or training cue in any input field."),
        ("Decision process", "Patterns in any case; the outcome is fixed by the text; nobody adjudicates and index keywords are not read."),
    ]
    return {
        "table_A11_education_screen_trace": Table(judged.select(*dict.fromkeys(c for c in shown if c in judged.columns)), small=False),
        "table_A11_education_screen_counts": Table(counts.withColumn("Percent of screened corpus", F.round("Percent of screened corpus", 2)), tuple(flags)),
        "table_A11_algorithm_specification": Table(judged.sparkSession.createDataFrame(rules, "Component string, `Operational rule` string")),
    }


def methods_text(judged: DataFrame) -> str:
    """A paragraph that states the screen and its counts, from one row."""
    included = F.col("Education_Screen_Disposition") == "include_algorithm"
    n = judged.agg(
        F.count(F.lit(1)).alias("all"), F.count_if(included).alias("kept"), F.count_if(~included & F.col("Has_Clinical_Use_Cue")).alias("clinical"), F.count_if(included & F.col("Tech_Category").isNotNull()).alias("classed")
    ).first()
    gone = n["all"] - n["kept"]
    return (
        "# Education screen\n\n"
        f"**{n['all']:,}** records were screened by fixed patterns over {', '.join(lx.SCREEN_FIELDS).lower()}, in any case. A record is included where an education or training cue occurs; "
        "clinical cues neither include nor exclude, and computational phrases turn generic learning or training cues off unless another cue occurs.\n\n"
        f"Included: **{n['kept']:,}**. Excluded: **{gone:,}** ({n['clinical']:,} with clinical cues only, {gone - n['clinical']:,} with neither). Of the included ones **{n['classed']:,}** have a technology category and are the analysed corpus.\n"
    )
