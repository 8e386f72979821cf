"""Named queries over the driver's tables, each with its SQL oracle.

The tables stand for records: an order or a document is a record, its lines'
supplier nations are its addresses, the parts of its basket its keywords.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import entities, lexicon as lx, text as tx
from quillspark.operators import audit, classify, collab, dedup, dialect, graph, keywords, metrics, order
from quillspark.plans.export import EXPORT_SQL, records
from quillspark.plans.fixture import COLUMNS, RECORD_NAMES
from quillspark.session import table
from quillspark.sources import named
from quillspark.sources.records import canonical_columns, read_records

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


YEARS = (1995, 2001)
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


# Shared shapes


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc"), F.col("o_custkey").alias("author"), F.col("o_orderpriority").alias("category"),
        F.col("o_orderstatus").alias("orientation"), F.year("o_orderdate").cast("long").alias("year"), F.col("o_totalprice").alias("amount"),
    )


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their line count as citations."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.count(F.lit(1)).alias("cites"))
    return _orders(spark, sf_dir).join(lines, "doc", "left").fillna(0, ["cites"])


def _collab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the sorted nations of their lines, the first line's nation and the status."""
    nations = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").join(nations, "l_suppkey")
    sets = lines.groupBy(F.col("l_orderkey").alias("doc")).agg(F.sort_array(F.collect_set("n_name")).alias("countries"), F.min_by("n_name", F.struct("l_linenumber", "l_suppkey", "l_partkey")).alias("leader"))
    joined = _orders(spark, sf_dir).join(sets, "doc", "left")
    return joined.withColumn("collab", collab.status(F.coalesce(F.size("countries"), F.lit(0))))


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("item"), F.col("p_brand").alias("brand"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), "l_partkey", F.col("l_quantity").alias("quantity")).join(parts, "l_partkey").select("doc", "item", "brand", "quantity")


_O = "o AS (SELECT o_orderkey AS doc, o_custkey AS author, o_orderpriority AS category, o_orderstatus AS orientation, CAST(year(o_orderdate) AS BIGINT) AS year, o_totalprice AS amount FROM orders)"
_C = _O + ",\nc AS (SELECT o.*, coalesce(n, 0) AS cites FROM o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = doc)"
_F = _C + ",\nf AS (SELECT 'Full Corpus' AS grp, * FROM c UNION ALL SELECT category AS grp, * FROM c)"
_K = _O + """,
ln AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
ld AS (SELECT l_orderkey, n_name AS leader FROM ln QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) = 1),
cn AS (SELECT l_orderkey, count(DISTINCT n_name) AS k FROM ln GROUP BY 1),
k AS (SELECT o.*, leader, coalesce(k, 0) AS k, CASE WHEN k > 1 THEN 'MCP' WHEN k = 1 THEN 'SCP' ELSE 'Unresolved' END AS collab FROM o LEFT JOIN ld ON ld.l_orderkey = doc LEFT JOIN cn ON cn.l_orderkey = doc)"""
_B = "b AS (SELECT l_orderkey AS doc, p_name AS item, p_brand AS brand, l_quantity AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _h(rows: str, keys: str, cites: str) -> str:
    """The h-index the long way: ranks of all documents."""
    return f"(SELECT {keys}, CAST(sum(CASE WHEN v >= rn THEN 1 ELSE 0 END) AS BIGINT) AS h_index FROM (SELECT *, floor({cites}) AS v, row_number() OVER (PARTITION BY {keys} ORDER BY floor({cites}) DESC) AS rn FROM {rows}) GROUP BY {keys})"


# Growth, citations, indices


@query(f"""WITH {_O},
s AS (SELECT category, y.year FROM (SELECT DISTINCT category FROM o), (SELECT CAST(unnest(range(1995, 2002)) AS BIGINT) AS year) y),
a AS (SELECT category, year, count(*) AS n, sum(amount) AS tc FROM o GROUP BY ALL)
SELECT s.category, s.year, coalesce(n, 0) AS n, round(coalesce(tc, 0.0), 2) AS tc, round(CASE WHEN coalesce(n, 0) > 0 THEN tc / n ELSE 0.0 END, 4) AS impact
FROM s LEFT JOIN a ON s.category = a.category AND s.year = a.year""")
def yearly_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.yearly(_orders(spark, sf_dir), "category", "year", "amount", *YEARS).select("category", "year", "n", F.round("tc", 2).alias("tc"), F.round("impact", 4).alias("impact"))


@query(f"""WITH {_O}, a AS (SELECT category, year, count(*) AS n FROM o GROUP BY ALL)
SELECT category, year, n, CAST(sum(n) OVER (PARTITION BY category ORDER BY year) AS BIGINT) AS cumulative FROM a""")
def cumulative_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cumulative(_orders(spark, sf_dir).groupBy("category", "year").agg(F.count(F.lit(1)).alias("n")), "category", "year", "n")


@query(f"""WITH {_F}, y AS (SELECT grp, year, count(*) AS n FROM f GROUP BY ALL),
p AS (SELECT grp, year AS peak_year FROM y QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, year) = 1),
g AS (SELECT grp, arg_min(n, year) AS n0, arg_max(n, year) AS n1, min(year) AS y0, max(year) AS y1 FROM y GROUP BY grp),
t AS (SELECT grp, count(*) AS documents, CAST(sum(cites) AS DOUBLE) AS tc, CAST(sum(CASE WHEN cites > 0 THEN 1 ELSE 0 END) AS BIGINT) AS ncp FROM f GROUP BY grp)
SELECT t.grp AS category, documents, tc, h_index, round(CASE WHEN y1 > y0 THEN (pow(n1 / n0, 1.0 / (y1 - y0)) - 1) * 100 ELSE 0.0 END, 4) AS growth,
  round(tc / documents, 4) AS ac, ncp, round(100.0 * ncp / documents, 4) AS pct_cited, round(CASE WHEN ncp > 0 THEN tc / ncp ELSE 0.0 END, 4) AS ccp, y0 AS first_year, peak_year
FROM t JOIN p ON t.grp = p.grp JOIN g ON t.grp = g.grp JOIN {_h('f', 'grp', 'cites')} h ON t.grp = h.grp""")
def main_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.main_metrics(_cited(spark, sf_dir), "category", "year", "cites")
    return out.withColumns({c: F.round(c, 4) for c in ("growth", "ac", "pct_cited", "ccp")})


@query(f"SELECT * FROM {_h('lineitem', 'l_suppkey', 'l_quantity')}")
def h_index_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.h_index(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity")


@query("""SELECT CAST(sum(CASE WHEN v >= rn THEN 1 ELSE 0 END) AS BIGINT) AS h_index FROM (SELECT floor(l_quantity) AS v, row_number() OVER (ORDER BY floor(l_quantity) DESC) AS rn FROM lineitem)""")
def h_index_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.h_index(table(spark, sf_dir, "lineitem").select("l_quantity", F.lit(0).alias("all")), ["all"], "l_quantity").select("h_index")


@query(f"""WITH {_C} SELECT s.category, s.author, pubs, citations, h_index FROM (SELECT category, author, count(*) AS pubs, CAST(sum(cites) AS BIGINT) AS citations FROM c GROUP BY ALL) s
JOIN {_h('c', 'category, author', 'cites')} h ON s.category = h.category AND s.author = h.author""")
def author_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cited(spark, sf_dir)
    stats = rows.groupBy("category", "author").agg(F.count(F.lit(1)).alias("pubs"), F.sum("cites").alias("citations"))
    return stats.join(metrics.h_index(rows, ["category", "author"], "cites"), ["category", "author"])


@query(f"""WITH {_K}, v AS (SELECT author, leader, count(*) AS n, min(doc) AS first FROM k WHERE leader IS NOT NULL GROUP BY ALL)
SELECT author, leader, n FROM v QUALIFY row_number() OVER (PARTITION BY author ORDER BY n DESC, first) = 1""")
def majority_affiliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.majority(_collab(spark, sf_dir), ["author"], "leader", "doc")


@query(f"""WITH d AS (SELECT source, floor(n_chars / 1000) AS cites FROM documents), s AS (SELECT source, count(*) AS articles, CAST(sum(cites) AS DOUBLE) AS tc FROM d GROUP BY 1),
t AS (SELECT *, row_number() OVER (ORDER BY articles DESC, source) AS rank FROM s QUALIFY rank <= 20)
SELECT rank, t.source, articles, tc, round(tc / articles, 4) AS cpp, h_index FROM t JOIN {_h('d', 'source', 'cites')} h ON t.source = h.source""")
def source_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", F.floor(F.col("n_chars") / 1000).alias("cites"))
    return metrics.source_table(docs, "source", "cites").withColumn("cpp", F.round("cpp", 4))


@query(f"""WITH {_F}, s AS (SELECT grp, author, count(*) AS n FROM f GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY grp) AS t, sum(n) OVER (PARTITION BY grp ORDER BY n DESC, author ROWS UNBOUNDED PRECEDING) - n AS before FROM s),
z AS (SELECT *, CASE WHEN 3 * before < t THEN 1 WHEN 3 * before < 2 * t THEN 2 ELSE 3 END AS z FROM w)
SELECT grp AS category, CAST(max(t) AS BIGINT) AS total_articles, CAST(sum(CASE WHEN z = 1 THEN 1 ELSE 0 END) AS BIGINT) AS zone1_journals, CAST(sum(CASE WHEN z = 1 THEN n ELSE 0 END) AS BIGINT) AS zone1_articles,
  CAST(sum(CASE WHEN z = 2 THEN 1 ELSE 0 END) AS BIGINT) AS zone2_journals, CAST(sum(CASE WHEN z = 2 THEN n ELSE 0 END) AS BIGINT) AS zone2_articles,
  CAST(sum(CASE WHEN z = 3 THEN 1 ELSE 0 END) AS BIGINT) AS zone3_journals, CAST(sum(CASE WHEN z = 3 THEN n ELSE 0 END) AS BIGINT) AS zone3_articles FROM z GROUP BY grp""")
def bradford_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bradford(_orders(spark, sf_dir), "category", "author")


@query(f"""WITH {_B}, x AS (SELECT brand, CAST(year(o_orderdate) AS BIGINT) AS year FROM b JOIN orders ON doc = o_orderkey), t AS (SELECT brand FROM x GROUP BY 1 ORDER BY count(*) DESC, brand LIMIT 10)
SELECT brand, year, count(*) AS n FROM x WHERE brand IN (SELECT brand FROM t) GROUP BY ALL""")
def top_source_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _baskets(spark, sf_dir).select("doc", "brand").join(_orders(spark, sf_dir).select("doc", "year"), "doc").groupBy("brand", "year").agg(F.count(F.lit(1)).alias("n"))
    top = metrics.top_k(rows.groupBy("brand").agg(F.sum("n").alias("total")), 10, [F.desc("total"), F.asc("brand")])
    return rows.join(F.broadcast(top.select("brand")), "brand", "left_semi")  # ten rows


# Collaboration


@query(f"WITH {_K} SELECT category, collab, count(*) AS n FROM k GROUP BY ALL")
def collab_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collab(spark, sf_dir).groupBy("category", "collab").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_K}, a AS (SELECT n_name AS country, count(DISTINCT l_orderkey) AS documents FROM ln WHERE l_orderkey IN (SELECT doc FROM o) GROUP BY 1), l AS (SELECT leader AS country, count(*) AS led FROM k WHERE leader IS NOT NULL GROUP BY 1)
SELECT a.country, documents, coalesce(led, 0) AS led, round(100.0 * documents / (SELECT count(*) FROM o), 4) AS percent FROM a LEFT JOIN l ON a.country = l.country""")
def country_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collab.contributions(_collab(spark, sf_dir), "countries", "leader").withColumn("percent", F.round("percent", 4))


def _pivot_sql(where: str, limit: str) -> str:
    cells = ", ".join(f"CAST(sum(CASE WHEN category = '{g}' AND collab = '{c}' THEN 1 ELSE 0 END) AS BIGINT) AS \"{g}_{c}\"" for g in PRIORITIES for c in ("SCP", "MCP"))
    return f"""WITH {_K} SELECT leader AS country, {cells}, CAST(sum(CASE WHEN collab = 'SCP' THEN 1 ELSE 0 END) AS BIGINT) AS total_scp, CAST(sum(CASE WHEN collab = 'MCP' THEN 1 ELSE 0 END) AS BIGINT) AS total_mcp, count(*) AS total
FROM k WHERE leader IS NOT NULL AND {where} GROUP BY leader {limit}"""


FIXED_ORDER = ["CHINA", "FRANCE", "GERMANY", "JAPAN", "UNITED KINGDOM", "UNITED STATES", "NATION_1", "NATION_2", "NATION_3"]


@query(_pivot_sql("true", "ORDER BY total DESC, leader LIMIT 12"))
def collab_pivot_top12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collab.pivot(_collab(spark, sf_dir), "leader", "category", "collab", PRIORITIES, k=12)


@query(_pivot_sql("leader IN (" + ", ".join(f"'{x}'" for x in FIXED_ORDER) + ")", ""))
def collab_fixed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collab.pivot(_collab(spark, sf_dir), "leader", "category", "collab", PRIORITIES, only=FIXED_ORDER)


@query(f"""WITH {_K}, t AS (SELECT CAST(sum(CASE WHEN collab = 'SCP' THEN 1 ELSE 0 END) AS BIGINT) AS scp, CAST(sum(CASE WHEN collab = 'MCP' THEN 1 ELSE 0 END) AS BIGINT) AS mcp, count(*) AS total, count(leader) AS identifiable, CAST(sum(CASE WHEN collab = 'Unresolved' THEN 1 ELSE 0 END) AS BIGINT) AS unresolved FROM k),
s AS (SELECT CAST(sum(n) AS BIGINT) AS shown FROM (SELECT count(*) AS n FROM k WHERE leader IS NOT NULL GROUP BY leader ORDER BY n DESC, leader LIMIT 12))
SELECT scp, mcp, total, identifiable, unresolved, shown, round(shown / identifiable, 6) AS coverage, total - shown AS not_shown FROM t, s""")
def collab_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collab.summary(_collab(spark, sf_dir), "leader", "collab")


@query(f"""WITH {_K}, n AS (SELECT leader, category, count(*) AS documents, CAST(sum(CASE WHEN collab = 'MCP' THEN 1 ELSE 0 END) AS BIGINT) AS mcp FROM k WHERE collab <> 'Unresolved' GROUP BY ALL HAVING count(*) >= 10),
w AS (SELECT *, mcp / documents AS p, 1.96 AS z FROM n)
SELECT leader, category, documents, mcp, round(p, 6) AS proportion,
  round(greatest(0.0, (p + z * z / (2 * documents) - z * sqrt(p * (1 - p) / documents + z * z / (4.0 * documents * documents))) / (1 + z * z / documents)), 6) AS low,
  round(least(1.0, (p + z * z / (2 * documents) + z * sqrt(p * (1 - p) / documents + z * z / (4.0 * documents * documents))) / (1 + z * z / documents)), 6) AS high FROM w""")
def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = collab.mcp_rates(_collab(spark, sf_dir), ["leader", "category"], "collab")
    return out.withColumns({c: F.round(c, 6) for c in ("proportion", "low", "high")})


@query(f"""WITH {_K}, n AS (SELECT collab, leader AS country, count(*) AS n FROM k GROUP BY ALL), t AS (SELECT * FROM n WHERE country IS NOT NULL QUALIFY row_number() OVER (PARTITION BY collab ORDER BY n DESC, country) <= 10)
SELECT * FROM t UNION ALL SELECT collab, 'Others / unresolved', CAST(sum(n) AS BIGINT) FROM n WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.collab = n.collab AND t.country = n.country) GROUP BY 1""")
def donut_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collab.residual(_collab(spark, sf_dir), "leader", "collab").select("collab", "country", "n")


_RCA = """n AS (SELECT n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
r AS (SELECT n_name, sum(n) AS row_n FROM n GROUP BY 1 HAVING sum(n) >= 10), s AS (SELECT c_mktsegment, sum(n) AS column_n FROM n GROUP BY 1), t AS (SELECT sum(n) AS total FROM n)"""


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "c_mktsegment")


@query(f"""WITH {_RCA} SELECT r.n_name, s.c_mktsegment, CAST(row_n AS BIGINT) AS row_n, coalesce(n, 0) AS n, round((coalesce(n, 0) / row_n) / (column_n / total), 6) AS rca
FROM r CROSS JOIN s CROSS JOIN t LEFT JOIN n ON n.n_name = r.n_name AND n.c_mktsegment = s.c_mktsegment""")
def rca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rca(_customers(spark, sf_dir), "n_name", "c_mktsegment").withColumn("rca", F.round("rca", 6))


def _uniform_sql(begin: int) -> str:
    return f"((CAST('0x' || substr(md5(key), {begin}, {metrics.UNIFORM_DIGITS}) AS BIGINT)::DOUBLE + 0.5) / {float(16**metrics.UNIFORM_DIGITS)!r})"


@query(f"""WITH {_RCA}, p(m, steps) AS (VALUES {", ".join(f"({m}, {metrics.poisson_steps(m)!r}::DOUBLE[])" for m in range(1, metrics.SMALL_CELL + 1))}),
d AS (SELECT n_name, c_mktsegment, n, steps, rep, '20260929|' || rep || '|' || n_name || '|' || c_mktsegment AS key FROM n LEFT JOIN p ON m = n, (SELECT unnest(range(1000)) AS rep)),
u AS (SELECT *, {_uniform_sql(1)} AS u, {_uniform_sql(1 + metrics.UNIFORM_DIGITS)} AS v FROM d), z AS (SELECT *, sqrt(-2 * ln(u)) * cos(2 * pi() * v) AS z FROM u),
k AS (SELECT rep, n_name, c_mktsegment, CASE WHEN n <= {metrics.SMALL_CELL} THEN len(list_filter(steps, lambda c: c < u))::DOUBLE ELSE greatest(0.0, floor(n + sqrt(n) * z + (z * z - 1) / 6 + 0.5)) END AS k FROM z),
w AS (SELECT n_name, c_mktsegment, k, sum(k) OVER (PARTITION BY rep, n_name) AS r, sum(k) OVER (PARTITION BY rep, c_mktsegment) AS c, sum(k) OVER (PARTITION BY rep) AS t FROM k),
b AS (SELECT n_name, c_mktsegment, quantile_cont((k / r) / (c / t), 0.025) AS low, quantile_cont((k / r) / (c / t), 0.975) AS high, count(*) AS replicates FROM w WHERE r > 0 AND c > 0 GROUP BY ALL)
SELECT r.n_name, s.c_mktsegment, CAST(row_n AS BIGINT) AS row_n, coalesce(n.n, 0) AS n, round((coalesce(n.n, 0) / row_n) / (column_n / total), 6) AS rca, round(low, 6) AS low, round(high, 6) AS high, replicates
FROM r CROSS JOIN s CROSS JOIN t LEFT JOIN n ON n.n_name = r.n_name AND n.c_mktsegment = s.c_mktsegment LEFT JOIN b ON b.n_name = r.n_name AND b.c_mktsegment = s.c_mktsegment""")
def rca_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = metrics.rca_bootstrap(_customers(spark, sf_dir), "n_name", "c_mktsegment")
    return bounds.withColumns({c: F.round(c, 6) for c in ("rca", "low", "high")})


# Counts and shares


@query(f"""WITH {_O} SELECT year, CAST(sum(CASE WHEN orientation = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f, CAST(sum(CASE WHEN orientation = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS o, CAST(sum(CASE WHEN orientation = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS p FROM o GROUP BY year""")
def orientation_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _orders(spark, sf_dir).groupBy("year").pivot("orientation", ["F", "O", "P"]).count().fillna(0)
    return wide.select("year", *[F.col(c).alias(c.lower()) for c in ("F", "O", "P")])


@query(f"WITH {_O}, n AS (SELECT year, orientation, category, count(*) AS n FROM o GROUP BY ALL) SELECT *, round(100.0 * n / sum(n) OVER (PARTITION BY year), 4) AS percent FROM n")
def row_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _orders(spark, sf_dir).groupBy("year", "orientation", "category").agg(F.count(F.lit(1)).alias("n"))
    years = counts.groupBy("year").agg(F.sum("n").alias("total"))
    return counts.join(years, "year").select("year", "orientation", "category", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("percent"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")


@query("SELECT lang, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def group_counts_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).groupBy("lang", F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 2) AS percent FROM documents GROUP BY lang")
def percent_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return metrics.percent_of_total(counts, "n").withColumn("percent", F.round("percent", 2))


@query("""SELECT source, CAST(sum(quality) AS BIGINT) AS good, CAST(sum(toxic) AS BIGINT) AS toxic, round(100 * avg(quality), 4) AS good_percent, round(100 * avg(toxic), 4) AS toxic_percent FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def flag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("source").agg(F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"), F.round(100 * F.avg("quality"), 4).alias("good_percent"), F.round(100 * F.avg("toxic"), 4).alias("toxic_percent"))


# Terms and classes on documents, with lists of words that occur in them

DOC_VR, DOC_AR, DOC_MR, DOC_XR = ["the ", "that"], [" de ", "que "], ["stupid", " und "], [" los ", "nicht"]
DOC_TECHNICAL, DOC_PEDAGOGICAL = ["tion", "ing ", "token", "license", "ver"], ["ed ", "er ", "ment", "eau", "keit", "ción"]


def _like(terms: list[str], text: str = "t") -> str:
    return "(" + " OR ".join(f"contains({text}, '{x}')" for x in terms) + ")"


def _score(terms: list[str], text: str = "t") -> str:
    return "(" + " + ".join(f"CAST(contains({text}, '{x}') AS INT)" for x in terms) + ")"


def _padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", tx.joined_lower(["text"], padded=True).alias("t"))


_D = "d AS (SELECT doc_id, lang, ' ' || lower(text) || ' ' AS t FROM documents)"


@query(f"WITH {_D} SELECT doc_id FROM d WHERE {_like(DOC_VR + DOC_XR)}")
def thematic_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.thematic(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], DOC_VR + DOC_XR).select("doc_id")


@query(f"WITH {_D} SELECT doc_id, concat_ws('; ', {', '.join(f'''CASE WHEN contains(t, '{x}') THEN '{x.strip()}' END''' for x in DOC_TECHNICAL + DOC_PEDAGOGICAL)}) AS terms FROM d")
def matched_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _padded(spark, sf_dir).select("doc_id", tx.matched_terms("t", DOC_TECHNICAL + DOC_PEDAGOGICAL).alias("terms"))


@query(f"""WITH {_D} SELECT doc_id, CASE WHEN {_like(DOC_MR)} THEN 'MR' WHEN {_like(DOC_XR)} THEN 'XR' WHEN {_like(DOC_VR)} AND {_like(DOC_AR)} THEN 'Hybrid/Multi-technology' WHEN {_like(DOC_AR)} THEN 'AR' WHEN {_like(DOC_VR)} THEN 'VR' END AS category FROM d""")
def priority_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _padded(spark, sf_dir).select("doc_id", classify.technology(F.col("t"), DOC_VR, DOC_AR, DOC_MR, DOC_XR).alias("category"))


@query(f"""WITH {_D} SELECT doc_id, {_score(DOC_TECHNICAL)} AS technical, {_score(DOC_PEDAGOGICAL)} AS pedagogical, CASE WHEN {_score(DOC_PEDAGOGICAL)} >= {_score(DOC_TECHNICAL)} THEN 'Pedagogical' ELSE 'Technical' END AS orientation FROM d""")
def orientation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _padded(spark, sf_dir).select("doc_id", tx.term_score("t", DOC_TECHNICAL).alias("technical"), tx.term_score("t", DOC_PEDAGOGICAL).alias("pedagogical"), classify.orientation(F.col("t"), DOC_TECHNICAL, DOC_PEDAGOGICAL).alias("orientation"))


# Records: every rule with the fixed term lists, over the export that the given tables make


def _quoted(s: str) -> str:
    return s.replace("'", "''")


def _q(terms: list[str], text: str = "t") -> str:
    return "(" + " OR ".join(f"contains({text}, '{_quoted(x)}')" for x in terms) + ")"


_R = f"r AS ({EXPORT_SQL}),\nt AS (SELECT *, ' ' || lower(concat_ws(' ', title, abstract, author_keywords, index_keywords)) || ' ' AS t, lower(concat_ws(' ', title, abstract, author_keywords)) AS s FROM r)"


_CLASS = f"CASE WHEN {_q(lx.MR_TERMS)} THEN 'MR' WHEN {_q(lx.XR_TERMS)} THEN 'XR' WHEN {_q(lx.VR_TERMS)} AND {_q(lx.AR_TERMS)} THEN 'Hybrid/Multi-technology' WHEN {_q(lx.AR_TERMS)} THEN 'AR' WHEN {_q(lx.VR_TERMS)} THEN 'VR' END"


_ORIENTATION = f"""CASE WHEN {'+'.join(f"CAST(contains(s, '{_quoted(x)}') AS INT)" for x in lx.PEDAGOGICAL_TERMS)} >= {'+'.join(f"CAST(contains(s, '{_quoted(x)}') AS INT)" for x in lx.TECHNICAL_TERMS)} THEN 'Pedagogical' ELSE 'Technical' END"""


@query(f"""WITH {_R}, c AS (SELECT *, {_CLASS} AS category FROM t)
SELECT row_id, category, CASE WHEN category IS NOT NULL THEN CASE WHEN {'+'.join(f"CAST(contains(s, '{_quoted(x)}') AS INT)" for x in lx.PEDAGOGICAL_TERMS)} >= {'+'.join(f"CAST(contains(s, '{_quoted(x)}') AS INT)" for x in lx.TECHNICAL_TERMS)} THEN 'Pedagogical' ELSE 'Technical' END END AS orientation FROM c""")
def record_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classified(records(spark, sf_dir)).select(F.col("_row_id").alias("row_id"), F.col("Tech_Category").alias("category"), F.col("Orientation").alias("orientation"))


def _labels_sql(patterns: dict[str, str]) -> str:
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN regexp_matches(s, '{p}') THEN '{_quoted(k)}' END" for k, p in patterns.items()) + ")"


def _any_sql(patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches(s, '{p}')" for p in patterns) + ")"


_SUBSTANTIVE = [p for k, p in lx.EDUCATION_PATTERNS.items() if k not in lx.GENERIC_LEARNING_LABELS]


@query(f"""WITH {_R}, e AS (SELECT *, {_any_sql(_SUBSTANTIVE)} OR ({_any_sql(lx.EDUCATION_PATTERNS.values())} AND NOT {_any_sql(lx.MACHINE_LEARNING_PATTERNS)}) AS cue FROM t)
SELECT row_id, cue, {_any_sql(lx.CLINICAL_PATTERNS.values())} AS clinical, CASE WHEN cue THEN {_labels_sql(lx.EDUCATION_PATTERNS)} ELSE '' END AS education_cues, {_labels_sql(lx.CLINICAL_PATTERNS)} AS clinical_cues, CASE WHEN cue THEN 'include_algorithm' ELSE 'exclude_algorithm' END AS disposition FROM e""")
def record_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify.screened(records(spark, sf_dir), ["Title", "Abstract", "Author Keywords"])
    return out.select(F.col("_row_id").alias("row_id"), F.col("Has_Education_Cue").alias("cue"), F.col("Has_Clinical_Use_Cue").alias("clinical"), F.col("Matched_Education_Cues").alias("education_cues"), F.col("Matched_Clinical_Use_Cues").alias("clinical_cues"), F.col("Education_Screen_Disposition").alias("disposition"))


_TRACED = {"vr": ("u", lx.VR_TERMS), "ar": ("u", lx.AR_TERMS), "exclusion": ("u", lx.EXCLUSION_TERMS), "hardware_rescue": ("u", lx.HARDWARE_TERMS), "technical": ("s", lx.TECHNICAL_TERMS), "pedagogical": ("s", lx.PEDAGOGICAL_TERMS)}


def _terms_sql(text: str, terms: list[str]) -> str:
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN contains({text}, '{_quoted(x)}') THEN '{_quoted(x.strip())}' END" for x in terms) + ")"


@query(f"""WITH {_R}, u AS (SELECT *, lower(concat_ws(' ', title, abstract, author_keywords, index_keywords)) AS u FROM t)
SELECT row_id, {', '.join(f'{_terms_sql(text, terms)} AS matched_{name}_terms' for name, (text, terms) in _TRACED.items())} FROM u""")
def record_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classification_trace(records(spark, sf_dir)).select(F.col("_row_id").alias("row_id"), *[F.col(f"matched_{n}_terms").alias(f"matched_{n}_terms") for n in _TRACED])


@query(f"""WITH {_R} SELECT CAST(sum(CAST({_q(lx.EDUCATION_SIGNALS, 's')} AS INT)) AS BIGINT) AS education, CAST(sum(CAST({_q(lx.HEALTH_SIGNALS, 's')} AS INT)) AS BIGINT) AS health, count(*) AS n FROM t""")
def scope_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = records(spark, sf_dir).withColumn("s", tx.joined_lower(["Title", "Abstract", "Author Keywords"]))
    flags = classify.scope_signals(F.col("s"))
    return text.agg(F.sum(flags["Education_signal"].cast("long")).alias("education"), F.sum(flags["Health_or_clinical_signal"].cast("long")).alias("health"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_R} SELECT row_id, trim(regexp_replace(regexp_replace(strip_accents(lower(title)), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS title_key,
regexp_replace(coalesce(trim(lower(doi)), ''), '^(https?://(dx\\.)?doi\\.org/|doi:\\s*)', '') AS doi_key FROM r""")
def record_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select(F.col("_row_id").alias("row_id"), tx.title_key("Title").alias("title_key"), tx.doi_key("DOI").alias("doi_key"))


_ALIAS = "CASE k " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lx.COUNTRY_ALIASES.items()) + " ELSE array_to_string(list_transform(string_split(k, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') END"


@query(f"""WITH {_R}, g AS (SELECT row_id, generate_subscripts(string_split(coalesce(affiliations, ''), ';'), 1) AS pos, unnest(string_split(coalesce(affiliations, ''), ';')) AS seg FROM r),
p AS (SELECT row_id, pos, list_filter(list_transform(string_split(seg, ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM g),
k AS (SELECT row_id, pos, CASE WHEN len(parts) > 0 THEN regexp_replace(lower(parts[-1]), '\\s+', ' ', 'g') END AS k FROM p),
c AS (SELECT row_id, pos, CASE WHEN k IS NOT NULL AND k NOT IN ('nan', 'none', 'null', 'n/a') THEN {_ALIAS} END AS c FROM k)
SELECT row_id, coalesce(array_to_string(list_sort(list_distinct(list(c) FILTER (c IS NOT NULL))), '; '), '') AS countries, max(CASE WHEN pos = 1 THEN c END) AS leader FROM c GROUP BY row_id""")
def record_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select(F.col("_row_id").alias("row_id"), F.array_join(entities.countries("Affiliations"), "; ").alias("countries"), entities.leading_country("Affiliations").alias("leader"))


def _in(values) -> str:
    return "(" + ", ".join(f"'{_quoted(v)}'" for v in values) + ")"


def _any_part(terms, text: str = "lower(p)") -> str:
    return "(" + " OR ".join(f"contains({text}, '{_quoted(x)}')" for x in terms) + ")"


def _standard_sql(text: str) -> str:
    """Whole-word replacements in the table's order; the fixture has no such words side by side, of which this would miss the second."""
    for short, full in lx.AFFILIATION_NAMES.items():
        pattern = _quoted(f"(?i)(^|[^\\p{{L}}\\p{{N}}_]){re.escape(short)}([^\\p{{L}}\\p{{N}}_]|$)")
        text = f"regexp_replace({text}, '{pattern}', '\\1{_quoted(full)}\\2', 'g')"
    return text


_NAMED = "CASE " + " ".join(f"WHEN {_any_part(v, 'l')}" + (" OR regexp_matches(l, '\\bmit\\b')" if n.endswith("(MIT)") else "") + f" THEN '{_quoted(n)}'" for n, v in lx.INSTITUTION_ALIASES.items()) + " END"
_SHOWN = "CASE " + " ".join(f"WHEN contains(lower(affiliations), '{_quoted(k)}') THEN '{_quoted(v)}'" for k, v in lx.DISPLAY_INSTITUTIONS.items()) + " END"


@query(rf"""WITH {_R}, g AS (SELECT row_id, trim(x) AS seg, lower(trim(x)) AS l FROM (SELECT row_id, unnest(string_split(affiliations, ';')) AS x FROM r WHERE affiliations IS NOT NULL) WHERE trim(x) <> '' AND lower(trim(x)) <> 'nan'),
p AS (SELECT *, list_filter(list_transform(string_split(seg, ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM g),
u AS (SELECT *, list_filter(parts, lambda p: {_any_part(lx.UNIVERSITY_MARKERS)} AND lower(p) NOT IN {_in(lx.GENERIC_LABELS)}) AS us,
  list_filter(parts, lambda p: {_any_part([*lx.UNIVERSITY_MARKERS, *lx.ORGANISATION_MARKERS])} AND NOT regexp_matches(p, '(?i)^(?:{'|'.join(lx.SUB_UNIT_WORDS)})\b') AND lower(p) NOT IN {_in(lx.GENERIC_LABELS)}) AS bodies,
  list_filter(parts, lambda p: contains(lower(p), 'college') AND NOT regexp_matches(p, '(?i)^college\s+of\b')) AS colleges FROM p),
c AS (SELECT *, regexp_replace(us[1], '\s+', ' ', 'g') AS label FROM u),
k AS (SELECT *, CASE WHEN contains(lower(label), 'university college') THEN label ELSE trim(regexp_replace(label, '(?i)\s+(?:{'|'.join(lx.ATTACHED_UNIT_WORDS)})\b.*$', '')) END AS kept FROM c),
o AS (SELECT *, CASE WHEN lower(kept) IN ('the university of hong kong', 'university of hong kong') THEN 'The University of Hong Kong' ELSE kept END AS parent FROM k),
i AS (SELECT row_id, coalesce({_NAMED}, CASE WHEN lower(parts[1]) IN ('københavn', 'copenhagen') THEN 'Københavns Universitet' WHEN len(us) > 0 THEN CASE WHEN lower(parent) NOT IN {_in(lx.GENERIC_LABELS)} THEN parent END WHEN len(bodies) > 0 THEN bodies[1] ELSE colleges[1] END) AS inst FROM o),
a AS (SELECT row_id, array_to_string(list_sort(list(DISTINCT inst)), '; ') AS institutions FROM i WHERE inst IS NOT NULL GROUP BY row_id),
d AS (SELECT row_id, affiliations, list_transform(string_split(affiliations, ','), lambda x: trim(x)) AS parts FROM r),
e AS (SELECT *, coalesce(list_filter(parts, lambda p: length(p) >= 3 AND {_any_part(lx.DISPLAY_TARGETS)})[1], CASE WHEN length(parts[2]) > 3 THEN parts[2] END, parts[1]) AS best FROM d),
f AS (SELECT *, CASE WHEN parts[-1] <> '' THEN best || ' (' || parts[-1] || ')' ELSE best END AS long FROM e)
SELECT f.row_id, coalesce(institutions, '') AS institutions, CASE WHEN length(affiliations) >= 3 THEN coalesce({_SHOWN}, CASE WHEN length(long) > 40 THEN left(long, 40) || '..' ELSE long END) END AS label, {_standard_sql('affiliations')} AS standard FROM f LEFT JOIN a ON a.row_id = f.row_id""")
def record_institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select(F.col("_row_id").alias("row_id"), F.array_join(entities.institutions("Affiliations"), "; ").alias("institutions"), entities.display_institution("Affiliations").alias("label"), entities.standard_affiliations("Affiliations").alias("standard"))


@query(f"""WITH {_R}, n AS (SELECT row_id, regexp_replace(regexp_replace(regexp_replace(strip_accents(trim(x)), '\\s+', ' ', 'g'), ',\\s*', ', ', 'g'), '\\.([A-Za-z])', '. \\1', 'g') AS name, pos FROM (SELECT row_id, unnest(string_split(authors, ';')) AS x, generate_subscripts(string_split(authors, ';'), 1) AS pos FROM r WHERE authors IS NOT NULL) WHERE trim(x) <> '')
SELECT row_id, string_agg(name, '; ' ORDER BY pos) AS authors FROM n GROUP BY row_id""")
def record_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select(F.col("_row_id").alias("row_id"), entities.standard_authors("Authors").alias("authors")).filter("authors <> ''")


@query(rf"""WITH {_R}, p AS (SELECT row_id, list_transform(string_split(x, ','), lambda y: trim(y)) AS parts FROM (SELECT row_id, unnest(string_split(cited_works, ';')) AS x FROM r WHERE cited_works IS NOT NULL) WHERE trim(x) <> ''),
q AS (SELECT row_id, parts[1] AS surname, parts[2] AS given, regexp_extract_all(parts[2], '([A-Za-zÀ-ž]+)', 1) AS names FROM p WHERE len(parts) >= 3)
SELECT DISTINCT row_id, regexp_replace(surname || ', ' || array_to_string(list_transform(names, lambda t: upper(t[1])), '.') || '.', '\s+', ' ', 'g') AS author FROM q
WHERE length(surname) BETWEEN 1 AND 45 AND lower(surname) NOT IN {_in(lx.NOT_AUTHORS)} AND regexp_matches(surname, '[A-Za-zÀ-ž]') AND length(given) <= 50 AND len(names) BETWEEN 1 AND 5""")
def record_cited_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select(F.col("_row_id").alias("row_id"), F.explode(entities.cited_authors("References")).alias("author"))


_COLUMN_SQL = dict(zip(COLUMNS, RECORD_NAMES, strict=True))
_RICH = " + ".join(f"CAST(coalesce(trim({_COLUMN_SQL[c]}), '') <> '' AS INT)" for c in lx.COMPLETENESS_FIELDS if c in _COLUMN_SQL)
_PIPELINE = rf"""{_R},
x AS (SELECT t.*, {_RICH} AS rich, regexp_replace(coalesce(trim(lower(doi)), ''), '^(https?://(dx\.)?doi\.org/|doi:\s*)', '') AS k,
  trim(regexp_replace(regexp_replace(strip_accents(lower(title)), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS tk,
  CASE WHEN trim(string_split(coalesce(author_id, ''), ';')[1]) <> '' THEN trim(string_split(author_id, ';')[1]) ELSE lower(strip_accents(trim(string_split(coalesce(authors, ''), ';')[1]))) END AS ak FROM t),
p2 AS (SELECT * FROM x WHERE row_id IN (SELECT min(row_id) FROM r GROUP BY {", ".join(RECORD_NAMES)})),
p3 AS (SELECT * FROM p2 QUALIFY k = '' OR row_number() OVER (PARTITION BY k ORDER BY rich DESC, row_id) = 1),
g4 AS (SELECT *, coalesce(tk, '') <> '' AND coalesce(trim(year), '') <> '' AND coalesce(ak, '') <> '' AS whole, CASE WHEN k = '' THEN 1 ELSE 0 END AS bare, CASE WHEN k = '' THEN 0 ELSE -rich END AS o FROM p3),
h4 AS (SELECT *, count(DISTINCT CASE WHEN k <> '' THEN k END) OVER (PARTITION BY tk, year, ak, CASE WHEN NOT whole THEN row_id END) AS dois FROM g4),
p4 AS (SELECT * FROM h4 QUALIFY NOT whole OR row_number() OVER (PARTITION BY tk, year, ak, whole, CASE WHEN dois > 1 THEN k ELSE '' END ORDER BY rich DESC, bare, o, row_id) = 1),
p5 AS (SELECT *, CAST(TRY_CAST(trim(year) AS DOUBLE) AS INT) AS y FROM p4 WHERE {" AND ".join(f"coalesce(trim({_COLUMN_SQL[c]}), '') <> ''" for c in lx.ESSENTIAL_FIELDS)} AND TRY_CAST(trim(year) AS DOUBLE) IS NOT NULL),
p6 AS (SELECT * FROM p5 WHERE {_q(lx.THEMATIC_TERMS, "(' ' || s || ' ')")}),
p7 AS (SELECT * FROM p6 WHERE y BETWEEN {lx.YEAR_RANGE[0]} AND {lx.YEAR_RANGE[1]}),
p8 AS (SELECT * FROM p7 WHERE {_any_sql(_SUBSTANTIVE)} OR ({_any_sql(lx.EDUCATION_PATTERNS.values())} AND NOT {_any_sql(lx.MACHINE_LEARNING_PATTERNS)})),
p9 AS (SELECT * FROM p8 WHERE {_q(lx.MR_TERMS)} OR {_q(lx.XR_TERMS)} OR {_q(lx.VR_TERMS)} OR {_q(lx.AR_TERMS)})"""
_COUNTED = ["r", "r", "r", "p2", "p3", "p4", "p5", "p6", "p7", "p8", "p9"]


def _audit_sql() -> str:
    from quillspark.plans import corpus

    rows = " UNION ALL ".join(f"SELECT {i} AS stage_no, '{name}' AS stage, (SELECT count(*) FROM {t}) AS records" for i, (name, t) in enumerate(zip(corpus.CRITERIA, _COUNTED, strict=True)))
    return f"WITH {_PIPELINE}, n AS ({rows}) SELECT stage_no, stage, records, coalesce(lag(records) OVER (ORDER BY stage_no), records) AS before, coalesce(lag(records) OVER (ORDER BY stage_no), records) - records AS removed FROM n"


@query(_audit_sql())
def record_pipeline_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.plans import corpus

    return corpus.audit(records(spark, sf_dir))


@query(f"SELECT row_id FROM (WITH {_PIPELINE} SELECT row_id FROM p9)")
def record_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.plans import corpus

    return corpus.corpus(records(spark, sf_dir)).select(F.col("_row_id").alias("row_id"))


@query(f"""WITH {_R} SELECT row_id, CAST(TRY_CAST(trim(year) AS DOUBLE) AS INT) AS year FROM t WHERE {" AND ".join(f"coalesce(trim({_COLUMN_SQL[c]}), '') <> ''" for c in lx.ESSENTIAL_FIELDS)} AND TRY_CAST(trim(year) AS DOUBLE) BETWEEN {lx.YEAR_RANGE[0]} AND {lx.YEAR_RANGE[1]}""")
def record_essential_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.within_years(classify.essential(records(spark, sf_dir))).select(F.col("_row_id").alias("row_id"), F.col("Year").alias("year"))


@query(f"WITH {_R} SELECT row_id, {_RICH} AS filled FROM r")
def record_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select(F.col("_row_id").alias("row_id"), dedup.completeness([c for c in lx.COMPLETENESS_FIELDS if c in COLUMNS]).alias("filled"))


def _list_sql(field: str, item: str, keep: str) -> str:
    return f"SELECT row_id, pos, {item} AS item FROM (SELECT row_id, unnest(string_split({field}, ';')) AS x, generate_subscripts(string_split({field}, ';'), 1) AS pos FROM r WHERE {field} IS NOT NULL) WHERE trim(x) <> '' AND {keep}"


@query(f"""WITH {_R}, n AS ({_list_sql("authors", "trim(string_split(x, '(')[1])", "trim(string_split(x, '(')[1]) <> ''")}), w AS ({_list_sql("author_keywords", "lower(trim(x))", "length(trim(x)) >= 3")}),
m AS (SELECT row_id, CASE item {" ".join(f"WHEN '{_quoted(k)}' THEN '{_quoted(v)}'" for k, v in lx.KEYWORD_MAP.items())} ELSE item END AS item FROM w)
SELECT r.row_id, coalesce((SELECT string_agg(item, '|' ORDER BY pos) FROM n WHERE n.row_id = r.row_id), '') AS names, coalesce((SELECT string_agg(item, '|' ORDER BY pos) FROM w WHERE w.row_id = r.row_id), '') AS words,
  coalesce((SELECT string_agg(DISTINCT item, '|' ORDER BY item) FROM m WHERE m.row_id = r.row_id), '') AS mapped FROM r""")
def record_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author tokens, keyword tokens and keywords by the fixed table."""
    words = entities.keywords("Author Keywords")
    lists = {"names": entities.author_names("Authors"), "words": words, "mapped": F.array_sort(entities.mapped_keywords(words))}
    return records(spark, sf_dir).select(F.col("_row_id").alias("row_id"), *[F.array_join(c, "|").alias(n) for n, c in lists.items()])


@query("""SELECT CAST(doc_id AS VARCHAR) AS eid, 'NA, "' || lang || '";' || chr(10) || replace(text, chr(13), ' ') AS title, CASE WHEN source = 'web' THEN NULL ELSE source END AS source, CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END AS keywords FROM documents""")
def csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as an export with quoted breaks, a byte order mark, blank and missing-value cells, read back under its canonical columns."""
    docs = table(spark, sf_dir, "documents")
    title = F.concat(F.lit('NA, "'), "lang", F.lit('";\n'), F.translate("text", "\r", " "))
    export = docs.select(
        F.col("doc_id").cast("string").alias("\ufeffEID "), title.alias(" Document Title"), F.when(F.col("source") == "web", "NA").otherwise(F.col("source")).alias("Journal"),
        F.when(F.col("lang") == "en", "en").otherwise(" ").alias("Author Keywords"), F.lit("other").alias("de"),
    )
    path = graph.shared_path(spark)
    export.write.csv(path, header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    found = canonical_columns(read_records(spark, path, None))
    return found.select(F.col("EID").alias("eid"), F.col("Title").alias("title"), F.col("Source title").alias("source"), F.col("Author Keywords").alias("keywords"))


# Deduplication


@query("SELECT text, lang, min(doc_id) AS doc_id FROM documents GROUP BY text, lang")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id").select("text", "lang", "doc_id")


_T = "t AS (SELECT *, trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS title FROM documents),\nx AS (SELECT *, CASE WHEN title = '' THEN '' ELSE sha256(title) END AS k FROM t)"


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as titles; their keys are shuffled as digests."""
    titled = table(spark, sf_dir, "documents").withColumn("title", tx.title_key("text"))
    return titled.withColumn("k", F.when(F.col("title") == "", "").otherwise(F.sha2("title", 256)))


@query(f"WITH {_T} SELECT doc_id, title FROM t")
def title_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titled(spark, sf_dir).select("doc_id", "title")


@query(f"WITH {_T} SELECT doc_id FROM x WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY n_chars DESC, doc_id) = 1 UNION ALL SELECT doc_id FROM x WHERE k = ''")
def keyed_survivor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.keyed(_titled(spark, sf_dir).select("doc_id", "k", "n_chars"), "k", F.col("n_chars"), "doc_id").select("doc_id")


@query(f"""WITH {_T}, c AS (SELECT *, CASE WHEN source IN ('src1', 'src2', 'src3') THEN '' ELSE source END AS doi FROM x), n AS (SELECT *, count(DISTINCT nullif(doi, '')) OVER (PARTITION BY k, lang) AS dois FROM c WHERE k <> '')
SELECT doc_id FROM n QUALIFY row_number() OVER (PARTITION BY k, lang, CASE WHEN dois > 1 THEN doi ELSE '' END ORDER BY n_chars DESC, doc_id) = 1 UNION ALL SELECT doc_id FROM c WHERE k = ''""")
def guarded_title_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _titled(spark, sf_dir).select("doc_id", "k", "lang", "n_chars", F.when(F.col("source").isin("src1", "src2", "src3"), "").otherwise(F.col("source")).alias("doi"))
    return dedup.guarded(docs, ["k", "lang"], "doi", F.col("n_chars"), "doc_id").select("doc_id")


@query("SELECT page_id, regexp_replace(trim(lower(url)), '^https?://(www\\.)?', '') AS address FROM pages")
def url_prefix_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(tx.strip(F.lower("url")), r"^https?://(www\.)?", "").alias("address"))


# Keywords


@query(f"""WITH {_B}, j AS (SELECT doc, string_agg(DISTINCT item, '; ' ORDER BY item) AS kw FROM b GROUP BY doc)
SELECT doc, array_to_string(list_sort(list_filter(list_transform(string_split(kw, ';'), lambda x: lower(trim(x))), lambda x: length(x) > 2)), '; ') AS keywords FROM j""")
def keyword_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _baskets(spark, sf_dir).groupBy("doc").agg(F.array_join(F.sort_array(F.collect_set("item")), "; ").alias("kw"))
    return joined.select("doc", F.array_join(F.sort_array(entities.keywords("kw")), "; ").alias("keywords"))


@query(f"WITH {_B}, n AS (SELECT item AS keyword, count(*) AS n FROM (SELECT DISTINCT doc, item FROM b) GROUP BY 1) SELECT row_number() OVER (ORDER BY n DESC, keyword) AS rank, keyword, n FROM n QUALIFY rank <= 10")
def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _baskets(spark, sf_dir).select("doc", "item").distinct()
    return keywords.top_keywords(rows, F.array("item")).select("rank", "keyword", "n")


@query(f"WITH {_B}, n AS (SELECT brand, item AS keyword, count(*) AS n FROM (SELECT DISTINCT doc, brand, item FROM b) GROUP BY ALL) SELECT brand, row_number() OVER (PARTITION BY brand ORDER BY n DESC, keyword) AS rank, keyword, n FROM n QUALIFY rank <= 10")
def keyword_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _baskets(spark, sf_dir).select("doc", "brand", "item").distinct()
    return keywords.top_keywords(rows, F.array("item"), 10, ["brand"]).select("brand", "rank", "keyword", "n")


@query(f"""WITH {_B}, a AS (SELECT item AS w, count(*) AS n FROM (SELECT DISTINCT doc, item FROM b) GROUP BY 1), o AS (SELECT item AS w, count(*) AS n FROM b GROUP BY 1),
x AS (SELECT row_number() OVER (ORDER BY n DESC, w) AS rank, w, n FROM a QUALIFY rank <= 10), y AS (SELECT row_number() OVER (ORDER BY n DESC, w) AS rank, w, n FROM o QUALIFY rank <= 10)
SELECT rank, x.w AS left_keyword, x.n AS left_n, y.w AS right_keyword, y.n AS right_n FROM x FULL JOIN y USING (rank)""")
def rank_aligned_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies by document against raw occurrences."""
    rows = _baskets(spark, sf_dir).select("doc", "item")
    return keywords.rank_aligned(keywords.top_keywords(rows.distinct(), F.array("item")), keywords.top_keywords(rows, F.array("item")))


@query(f"""WITH {_B}, u AS (SELECT DISTINCT doc, item FROM b), t AS (SELECT item FROM u GROUP BY 1 ORDER BY count(*) DESC, item LIMIT 10), v AS (SELECT u.* FROM u JOIN t USING (item))
SELECT x.item AS "row", y.item AS "column", count(*) AS n FROM v x JOIN v y ON x.doc = y.doc GROUP BY ALL""")
def keyword_pair_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.matrix(_baskets(spark, sf_dir), "doc", "item")


@query()
def fuzzy_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = keywords.merged_spellings(_baskets(spark, sf_dir).select("doc", "item").distinct(), F.array("item"))
    return spark.createDataFrame(sorted(merged.items()), "spelling string, chosen string")


# Networks

_E = _B + """,
u AS (SELECT DISTINCT doc, item FROM b), f AS (SELECT item AS id, count(*) AS freq FROM u GROUP BY 1),
e AS (SELECT x.item AS src, y.item AS dst, count(*) AS weight FROM u x JOIN u y ON x.doc = y.doc AND x.item < y.item GROUP BY ALL),
mx AS (SELECT avg(weight) + stddev_pop(weight) AS m FROM e), g AS (SELECT e.* FROM e, mx WHERE weight >= m)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _baskets(spark, sf_dir).select("doc", "item")
    _, edges = graph.network(rows, "doc", "item", 1, 1)
    return edges.crossJoin(F.broadcast(edges.agg((F.avg("weight") + F.stddev_pop("weight")).alias("m")))).filter("weight >= m").drop("m")  # one row


@query(f"WITH {_E} SELECT src, dst, weight FROM e")
def cooccurrence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.network(_baskets(spark, sf_dir).select("doc", "item"), "doc", "item", 1, 1)[1]


@query("""WITH u AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey AS id FROM lineitem), f AS (SELECT id FROM u GROUP BY 1 HAVING count(*) >= 15), v AS (SELECT u.* FROM u JOIN f USING (id))
SELECT x.id AS src, y.id AS dst, count(*) AS weight FROM v x JOIN v y ON x.doc = y.doc AND x.id < y.id GROUP BY ALL HAVING count(*) >= 2""")
def cocitation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_suppkey").alias("cited"))
    return graph.network(rows, "doc", "cited", 15, 2)[1]


@query(f"WITH {_E} SELECT id, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS strength FROM (SELECT src AS id, weight FROM g UNION ALL SELECT dst, weight FROM g) GROUP BY id")
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_edges(spark, sf_dir))


@query(f"WITH {_E}, n AS (SELECT count(DISTINCT id) AS nodes FROM (SELECT src AS id FROM g UNION ALL SELECT dst FROM g)) SELECT nodes, (SELECT count(*) FROM g) AS edges, round(2.0 * (SELECT count(*) FROM g) / (nodes * (nodes - 1)), 6) AS density FROM n")
def degree_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.size_and_density(_edges(spark, sf_dir)).withColumn("density", F.round("density", 6))


@query(f"""WITH RECURSIVE {_E}, l AS (SELECT src AS a, dst AS b FROM g UNION ALL SELECT dst, src FROM g), w AS (SELECT DISTINCT a AS id, a AS seen FROM l UNION SELECT w.id, l.b FROM w JOIN l ON w.seen = l.a)
SELECT id, min(seen) AS component FROM w GROUP BY id""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(_edges(spark, sf_dir))


@query()
def louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.louvain(_edges(spark, sf_dir))


@query()
def communities_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the co-citation graph by moves and contraction on the executors."""
    return graph.communities(graph.checkpointed(cocitation_edges(spark, sf_dir)))


def _fixed_partition(edges: DataFrame, by: int) -> DataFrame:
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ids.select("id", (F.length("id") % by).cast("long").alias("cluster"))


@query(f"""WITH {_E}, p AS (SELECT src, dst, weight, length(src) % 4 AS a, length(dst) % 4 AS b FROM g), m AS (SELECT sum(weight) AS m FROM p),
d AS (SELECT c, sum(weight) AS d FROM (SELECT a AS c, weight FROM p UNION ALL SELECT b, weight FROM p) GROUP BY c), i AS (SELECT a AS c, sum(weight) AS w FROM p WHERE a = b GROUP BY 1)
SELECT round(sum(coalesce(w, 0) / m - pow(d / (2 * m), 2)), 6) AS modularity FROM d LEFT JOIN i USING (c), m""")
def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return graph.modularity(edges, _fixed_partition(edges, 4)).select(F.round("modularity", 6).alias("modularity"))


@query(f"""WITH {_E}, i AS (SELECT DISTINCT id FROM (SELECT src AS id FROM g UNION ALL SELECT dst FROM g)), p AS (SELECT length(id) % 4 AS x, length(id) % 3 AS y FROM i),
t AS (SELECT x, y, count(*) AS n FROM p GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM t), r AS (SELECT sum(n * (n - 1) / 2) AS r FROM (SELECT sum(n) AS n FROM t GROUP BY x)), c AS (SELECT sum(n * (n - 1) / 2) AS c FROM (SELECT sum(n) AS n FROM t GROUP BY y))
SELECT round((s - r * c / (t * (t - 1) / 2)) / ((r + c) / 2 - r * c / (t * (t - 1) / 2)), 6) AS ari FROM s, r, c""")
def adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return graph.adjusted_rand(_fixed_partition(edges, 4), _fixed_partition(edges, 3)).select(F.round("ari", 6).alias("ari"))


GRID = [(1, 1), (1, 30), (1, 45), (500, 45), (900, 45), (900, 55)]


@query(f"""WITH {_E}, q(min_freq, min_edge) AS (VALUES {', '.join(f'(CAST({a} AS BIGINT), CAST({b} AS BIGINT))' for a, b in GRID)}),
x AS (SELECT min_freq, min_edge, src, dst FROM q, e JOIN f a ON a.id = src JOIN f b ON b.id = dst WHERE weight >= min_edge AND a.freq >= min_freq AND b.freq >= min_freq),
n AS (SELECT min_freq, min_edge, count(*) AS nodes FROM q, f WHERE freq >= min_freq GROUP BY ALL), l AS (SELECT min_freq, min_edge, count(DISTINCT id) AS linked FROM (SELECT min_freq, min_edge, src AS id FROM x UNION ALL SELECT min_freq, min_edge, dst FROM x) GROUP BY ALL),
k AS (SELECT min_freq, min_edge, count(*) AS edges FROM x GROUP BY ALL)
SELECT q.min_freq, q.min_edge, coalesce(nodes, 0) AS nodes, coalesce(linked, 0) AS linked, coalesce(edges, 0) AS edges, round(CASE WHEN linked > 1 THEN 2.0 * edges / (linked * (linked - 1)) ELSE 0.0 END, 6) AS density
FROM q LEFT JOIN n ON n.min_freq = q.min_freq AND n.min_edge = q.min_edge LEFT JOIN l ON l.min_freq = q.min_freq AND l.min_edge = q.min_edge LEFT JOIN k ON k.min_freq = q.min_freq AND k.min_edge = q.min_edge""")
def sensitivity_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sensitivity(_baskets(spark, sf_dir).select("doc", "item"), "doc", "item", GRID).withColumn("density", F.round("density", 6))


@query()
def sensitivity_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.community_grid(_baskets(spark, sf_dir).select("doc", "item"), "doc", "item", GRID, GRID[2])


# Audit and sampling


@query("""WITH s AS (SELECT 0 AS stage_no, 'loaded' AS stage, count(*) AS records FROM documents UNION ALL SELECT 1, 'long', count(*) FROM documents WHERE n_chars >= 500
UNION ALL SELECT 2, 'english', count(*) FROM documents WHERE n_chars >= 500 AND lang = 'en' UNION ALL SELECT 3, 'lines', count(*) FROM documents WHERE n_chars >= 500 AND lang = 'en' AND contains(text, chr(10)))
SELECT *, coalesce(lag(records) OVER (ORDER BY stage_no), records) AS before, coalesce(lag(records) OVER (ORDER BY stage_no), records) - records AS removed FROM s""")
def stage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.funnel(table(spark, sf_dir, "documents"), [("long", F.col("n_chars") >= 500), ("english", F.col("lang") == "en"), ("lines", F.contains("text", F.lit("\n")))])


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY (doc_id * 7919 + 20260929) % 100003, doc_id) <= 50")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.struct((F.col("doc_id") * 7919 + 20260929) % 100003, "doc_id")
    return metrics.stratified(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", rank, 50).select("source", "doc_id")


@query(f"""WITH {_R}, c AS (SELECT {_CLASS} AS category, CAST(TRY_CAST(trim(year) AS DOUBLE) AS INT) AS y FROM t),
m AS (SELECT * FROM (VALUES {", ".join(f"('{c}', {y}, '{_quoted(t)}')" for c, v in lx.MILESTONES.items() for y, t in v)}) v(category, year, milestone))
SELECT m.category, m.year, milestone, count(c.category) AS records FROM m LEFT JOIN c ON c.category = m.category AND y = m.year GROUP BY ALL""")
def milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The milestones of each category with the category's records of that year."""
    marks = spark.createDataFrame([(c, y, t) for c, v in lx.MILESTONES.items() for y, t in v], "category string, year int, milestone string")
    classes = classify.classified(records(spark, sf_dir)).select(F.col("Tech_Category").alias("category"), tx.number("Year").cast("int").alias("year"))
    counts = classes.groupBy("category", "year").agg(F.count(F.lit(1)).alias("records"))
    return marks.join(counts, ["category", "year"], "left").fillna(0, ["records"])


# The dashboard dialect


_DR = f"r AS ({EXPORT_SQL}),\nt AS (SELECT *, lower(concat(coalesce(title, ''), ' ', coalesce(abstract, ''), ' ', coalesce(author_keywords, ''))) AS s, lower(concat(coalesce(title, ''), ' ', coalesce(abstract, ''), ' ', coalesce(author_keywords, ''), ' ', coalesce(index_keywords, ''))) AS t FROM r)"


_DASH_CLASS = f"CASE WHEN {_q(dialect.EXCLUSION_TERMS)} AND NOT {_q(dialect.ANCHOR_TERMS)} THEN NULL WHEN {_q(dialect.MR_TERMS)} THEN 'MR/XR' WHEN {_q(dialect.VR_TERMS)} AND {_q(dialect.AR_TERMS)} THEN 'Hybrid/Multi-technology' WHEN {_q(dialect.AR_TERMS)} THEN 'AR' WHEN {_q(dialect.VR_TERMS)} THEN 'VR' END"


@query(f"""WITH {_DR} SELECT row_id, {_DASH_CLASS} AS category,
CASE WHEN {_score(dialect.PEDAGOGICAL_TERMS, 's')} >= {_score(dialect.TECHNICAL_TERMS, 's')} THEN 'Pedagogical' ELSE 'Technical' END AS orientation FROM t""")
def dashboard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = records(spark, sf_dir).fillna("", lx.CLASSIFICATION_FIELDS)
    texts = whole.select(F.col("_row_id").alias("row_id"), tx.joined_lower(lx.CLASSIFICATION_FIELDS).alias("t"), tx.joined_lower(lx.SCREEN_FIELDS).alias("s"))
    return texts.select("row_id", dialect.technology(F.col("t")).alias("category"), dialect.orientation(F.col("s")).alias("orientation"))


_LISTED = "CASE regexp_replace(lower(trim(string_split(x, ',')[-1])), '[.\\s0-9]+$', '') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dialect.COUNTRY_NAMES.items()) + " END"


@query(f"""WITH r AS ({EXPORT_SQL}), g AS (SELECT row_id, generate_subscripts(string_split(coalesce(affiliations, ''), ';'), 1) AS pos, unnest(string_split(coalesce(affiliations, ''), ';')) AS x FROM r), c AS (SELECT row_id, pos, {_LISTED} AS c FROM g),
f AS (SELECT row_id, c, min(pos) AS pos FROM c WHERE c IS NOT NULL GROUP BY ALL)
SELECT r.row_id, coalesce((SELECT string_agg(c, '; ' ORDER BY pos) FROM f WHERE f.row_id = r.row_id), '') AS countries, (SELECT c FROM c WHERE c.row_id = r.row_id AND pos = 1) AS leader FROM r""")
def dashboard_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select(F.col("_row_id").alias("row_id"), F.array_join(dialect.countries("Affiliations"), "; ").alias("countries"), dialect.leading_country("Affiliations").alias("leader"))


@query(r"""WITH d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS k FROM documents)
SELECT doc_id FROM d QUALIFY k = '' OR row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1""")
def dashboard_title_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", dialect.title_key("text").alias("k"))
    return dialect.first_of_key(docs, F.col("k"), "doc_id").select("doc_id")


@query(f"""WITH {_O}, s AS (SELECT author, count(*) AS n FROM o GROUP BY 1), w AS (SELECT *, sum(n) OVER () AS t, sum(n) OVER (ORDER BY n DESC, author ROWS UNBOUNDED PRECEDING) AS upto FROM s),
z AS (SELECT n, CASE WHEN 3 * upto <= t THEN 1 WHEN 3 * upto <= 2 * t THEN 2 ELSE 3 END AS zone FROM w)
SELECT v.zone, count(n) AS sources, CAST(coalesce(sum(n), 0) AS BIGINT) AS documents FROM (VALUES (1), (2), (3)) v(zone) LEFT JOIN z ON z.zone = v.zone GROUP BY v.zone""")
def dashboard_bradford(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialect.bradford(_orders(spark, sf_dir).select("author"), "author")


@query(f"""WITH {_K}, m AS (SELECT leader, category, CASE WHEN k > 1 THEN 'MCP' ELSE 'SCP' END AS status FROM k WHERE leader IS NOT NULL)
SELECT leader AS country, {', '.join(f"CAST(sum(CASE WHEN category = '{g}' AND status = '{c}' THEN 1 ELSE 0 END) AS BIGINT) AS \"{g}_{c}\"" for g in PRIORITIES for c in ('SCP', 'MCP'))}, count(*) AS total FROM m GROUP BY leader ORDER BY total DESC, leader LIMIT 12""")
def dashboard_collab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialect.collaboration(_collab(spark, sf_dir), "leader", F.size("countries"), "category", PRIORITIES)


@query(f"""WITH {_C}, g AS (SELECT unnest([{', '.join(f"'{x}'" for x in ['All', *PRIORITIES])}]) AS card)
SELECT card, count(doc) AS records, CAST(coalesce(sum(cites), 0) AS DOUBLE) AS citations, round(100.0 * count(doc) / (SELECT count(*) FROM c), 1) AS share FROM g LEFT JOIN c ON card = 'All' OR card = category GROUP BY card""")
def dashboard_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialect.cards(_cited(spark, sf_dir), "category", "cites", PRIORITIES)


_DASH = rf"""c AS (SELECT row_id, {", ".join(rf"regexp_replace(coalesce({c}, ''), '^\s+|\s+$', '', 'g') AS {c}" for c in RECORD_NAMES)} FROM ({EXPORT_SQL}) e),
d2 AS (SELECT min(row_id) AS row_id, {", ".join(RECORD_NAMES)} FROM c GROUP BY {", ".join(RECORD_NAMES)}),
d3 AS (SELECT * FROM d2 QUALIFY doi = '' OR row_number() OVER (PARTITION BY lower(doi) ORDER BY row_id) = 1),
k4 AS (SELECT *, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS k FROM d3),
d4 AS (SELECT * FROM k4 QUALIFY k = '' OR row_number() OVER (PARTITION BY k ORDER BY row_id) = 1),
d5 AS (SELECT *, lower(concat_ws(' ', title, abstract, author_keywords)) AS s, lower(concat_ws(' ', title, abstract, author_keywords, index_keywords)) AS t FROM d4 WHERE title <> '' AND year <> '' AND source_title <> ''),
d6 AS (SELECT * FROM d5 WHERE {_q(dialect.THEMATIC_TERMS, "s")}),
d7 AS (SELECT *, {_DASH_CLASS} AS category FROM d6 WHERE TRY_CAST(regexp_extract(year, '^[+-]?[0-9]+') AS INT) BETWEEN {lx.YEAR_RANGE[0]} AND {lx.YEAR_RANGE[1]}),
d8 AS (SELECT * FROM d7 WHERE category IS NOT NULL OR (SELECT count(category) FROM d7) = 0),
n AS ({" UNION ALL ".join(f"SELECT {i} AS stage_no, 's{i}' AS stage, (SELECT count(*) FROM {t}) AS records" for i, t in enumerate(["c", "c", *[f"d{j}" for j in range(2, 9)]]))})"""


@query(f"WITH {_DASH} SELECT *, coalesce(lag(records) OVER (ORDER BY stage_no), records) AS before, coalesce(lag(records) OVER (ORDER BY stage_no), records) - records AS removed FROM n")
def dashboard_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.with_removed(dialect.stage_counts(records(spark, sf_dir)))


@query(rf"""WITH {_DASH}, x AS (SELECT category, TRY_CAST(regexp_extract(year, '^[+-]?[0-9]+') AS INT) AS y, coalesce(TRY_CAST(regexp_extract(cited_by, '^[+-]?[0-9]+(?:\.[0-9]+)?|^[+-]?\.[0-9]+') AS DOUBLE), 0) AS c FROM d8),
g AS (SELECT '{metrics.FULL}' AS l, y, c FROM x UNION ALL SELECT category, y, c FROM x WHERE category IS NOT NULL), h AS (SELECT l, coalesce(max(i) FILTER (c >= i), 0) AS h FROM (SELECT l, c, row_number() OVER (PARTITION BY l ORDER BY c DESC) AS i FROM g) GROUP BY l),
v AS (SELECT l, y, count(*) AS k FROM g GROUP BY ALL), w AS (SELECT l, min(y) AS a, max(y) AS z, arg_min(k, y) AS ka, arg_max(k, y) AS kz, arg_max(y, (k, -y)) AS p FROM v GROUP BY l),
s AS (SELECT l, count(*) AS n, sum(c) AS tc, count(*) FILTER (c > 0) AS ncp FROM g GROUP BY l)
SELECT l AS "Category", format('{{:,}}', n) AS "N", format('{{:,}}', tc::BIGINT) AS "Total Citations", h::VARCHAR AS "H-index", CASE WHEN z > a THEN printf('%.2f', (pow(kz::DOUBLE / ka, 1.0 / (z - a)) - 1) * 100) || '%' ELSE '—' END AS "CAGR", printf('%.2f', tc / n) AS "AC",
format('{{:,}}', ncp) AS "NCP", printf('%.1f', 100.0 * ncp / n) || '%' AS "%Cited", CASE WHEN ncp > 0 THEN printf('%.2f', tc / ncp) ELSE '0' END AS "CCP", a::VARCHAR AS "First Year", p::VARCHAR AS "Peak Year" FROM s JOIN h USING (l) JOIN w USING (l)""")
def dashboard_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The downloaded table, written as one named file and read back."""
    path = graph.shared_path(spark) + "/bibliometric_table.csv"
    named.write_named(dialect.download(dialect.stages(records(spark, sf_dir))[-1][1]), path, "all")
    return spark.read.csv(path, header=True)


# Reports


_CLASSED = f"c AS (SELECT *, {_CLASS} AS category, CAST(TRY_CAST(trim(year) AS DOUBLE) AS INT) AS y FROM t), o AS (SELECT *, CASE WHEN category IS NOT NULL THEN {_ORIENTATION} END AS orientation FROM c)"
_REPORT_LINES = [("records", "Total records", "true", "n"), ("records", "Classified", "category IS NOT NULL", "n"), ("records", "Excluded/Unknown", "category IS NULL", "n")]
_REPORT_LINES += [("technology", c, f"category = '{c}'", "n") for c in lx.CATEGORIES] + [("orientation", o, f"orientation = '{o}'", "k") for o in ("Technical", "Pedagogical")]


@query(f"WITH {_R}, {_CLASSED}, z AS (SELECT count(*) AS n, count(category) AS k FROM o) " + " UNION ALL ".join(f"SELECT {i} AS place, '{section}' AS section, '{label}' AS label, count(*) FILTER ({condition}) AS records, coalesce(round(100.0 * count(*) FILTER ({condition}) / nullif((SELECT {base} FROM z), 0), 1), 0.0) AS percent FROM o" for i, (section, label, condition, base) in enumerate(_REPORT_LINES)))
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The console's report on classes and orientations."""
    return classify.class_report(classify.classified(records(spark, sf_dir)))


@query(f"WITH {_R}, {_CLASSED} SELECT y AS year, category, orientation, count(*) AS n FROM o WHERE y IS NOT NULL AND category IS NOT NULL GROUP BY ALL")
def orientation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by year, class and orientation."""
    from quillspark.plans import modules

    dated = classify.classified(records(spark, sf_dir)).withColumn("Year", tx.number("Year").cast("int"))
    return modules.a2(dated)["table_A2_orientation_counts"].rows.toDF("year", "category", "orientation", "n")


@query("""WITH u AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey AS id FROM lineitem), f AS (SELECT id, count(*) AS freq FROM u GROUP BY 1 HAVING count(*) >= 15), v AS (SELECT u.* FROM u JOIN f USING (id)),
e AS (SELECT x.id AS src, y.id AS dst FROM v x JOIN v y ON x.doc = y.doc AND x.id < y.id GROUP BY ALL HAVING count(*) >= 2), n AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1)
SELECT id, degree, freq FROM n JOIN f USING (id) ORDER BY degree DESC, freq DESC, id LIMIT 8""")
def network_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes that a drawing of the co-citation graph names."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_suppkey").alias("cited"))
    return graph.shown_labels(*graph.network(rows, "doc", "cited", 15, 2), 8)


# Order of rows


@query("SELECT o_orderkey AS doc, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS ord FROM orders")
def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gapless numbers by amount."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), "o_totalprice")
    return order.numbered(rows, F.desc("o_totalprice"), F.asc("doc"), name="ord").select("doc", "ord")


@query(f"""WITH {_C}, q AS (SELECT *, row_number() OVER (ORDER BY year, amount DESC, doc) AS ord FROM c), s AS (SELECT author AS source, count(*) AS articles, sum(cites) AS tc, min(ord) AS first FROM q GROUP BY 1),
t AS (SELECT *, row_number() OVER (ORDER BY articles DESC, first) AS rank FROM s QUALIFY rank <= 20),
h AS (SELECT author, max(least(cites, n)) AS h FROM (SELECT author, cites, row_number() OVER (PARTITION BY author ORDER BY cites DESC) AS n FROM q) GROUP BY 1)
SELECT rank, source, articles, CAST(tc AS DOUBLE) AS tc, round(CAST(tc AS DOUBLE) / articles, 4) AS cpp, h AS h_index FROM t JOIN h ON author = source""")
def source_table_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of sources with equally many articles those seen first in the order of rows."""
    rows = order.numbered(_cited(spark, sf_dir), "year", F.desc("amount"), "doc", name="ord").withColumnRenamed("author", "source")
    return metrics.source_table(rows, "source", "cites", order="ord").withColumn("cpp", F.round("cpp", 4))


@query("""WITH b AS (SELECT l_suppkey, l_orderkey, l_linenumber, p_name || ' ' || p_size AS item FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT l_suppkey AS supplier, item AS keyword, count(*) AS n, min((l_orderkey, l_linenumber, item)) AS first FROM b GROUP BY ALL)
SELECT supplier, row_number() OVER (PARTITION BY supplier ORDER BY n DESC, first) AS rank, keyword, n FROM n QUALIFY rank <= 5""")
def keyword_topk_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equally frequent keywords of a group those seen first, by record and place in its list."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    baskets = lines.groupBy(F.col("l_suppkey").alias("supplier"), F.col("l_orderkey").alias("doc")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.concat_ws(" ", "p_name", "p_size").alias("item")))).getField("item").alias("items"))
    return keywords.top_keywords(baskets, F.col("items"), 5, ["supplier"], "doc").select("supplier", "rank", "keyword", "n")


# Networks and tables of the export


COMPONENT_GRID = [(1, 1), (1, 30), (1, 45), (500, 45), (900, 45), (900, 55)]


@query(f"""WITH RECURSIVE {_E}, q(min_freq, min_edge) AS (VALUES {', '.join(f'(CAST({a} AS BIGINT), CAST({b} AS BIGINT))' for a, b in COMPONENT_GRID)}),
x AS (SELECT min_freq, min_edge, src, dst FROM q, e JOIN f a ON a.id = src JOIN f b ON b.id = dst WHERE weight >= min_edge AND a.freq >= min_freq AND b.freq >= min_freq),
l AS (SELECT min_freq, min_edge, src AS a, dst AS b FROM x UNION ALL SELECT min_freq, min_edge, dst, src FROM x),
w AS (SELECT DISTINCT min_freq, min_edge, a AS id, a AS seen FROM l UNION SELECT w.min_freq, w.min_edge, w.id, l.b FROM w JOIN l ON w.seen = l.a AND w.min_freq = l.min_freq AND w.min_edge = l.min_edge)
SELECT min_freq, min_edge, id, min(seen) AS component FROM w GROUP BY ALL""")
def component_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of every configuration, all cut from spanning forests."""
    nodes, edges = graph.network(_baskets(spark, sf_dir).select("doc", "item"), "doc", "item", 1, 1)
    known = edges.join(nodes.select(F.col("id").alias("src"), F.col("freq").alias("fs")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("freq").alias("fd")), "dst")
    _, placed = graph.component_grid(graph.checkpointed(known), COMPONENT_GRID)
    parts = F.split("config", "/")
    return placed.select(parts[0].cast("long").alias("min_freq"), parts[1].cast("long").alias("min_edge"), "id", "component")


@query("""WITH u AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey AS id FROM lineitem), f AS (SELECT id, count(*) AS freq FROM u GROUP BY 1 HAVING count(*) >= 15), v AS (SELECT u.* FROM u JOIN f USING (id)),
e AS (SELECT x.id AS src, y.id AS dst FROM v x JOIN v y ON x.doc = y.doc AND x.id < y.id GROUP BY ALL HAVING count(*) >= 2), n AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1)
SELECT id, freq, n.id IS NOT NULL AS linked, coalesce(degree, 0) AS degree FROM f LEFT JOIN n USING (id)""")
def cocitation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eligible node with its documents, its degree and whether it is linked at the threshold."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_suppkey").alias("cited"))
    nodes, edges = graph.network(rows, "doc", "cited", 15, 2)
    return nodes.join(graph.degrees(edges), "id", "left").select("id", "freq", F.col("degree").isNotNull().alias("linked"), F.coalesce("degree", F.lit(0)).alias("degree"))


_NETWORK_LIMITS = {"Keywords": (5, 3, 12), "Authors": (2, 1, 40), "Institutions": (4, 2, 12)}


def _list_items(name: str, least: int, sql: str) -> str:
    return f"SELECT '{name}' AS network, row_id, pos, item FROM ({sql}) WHERE length(item) >= {least}"


def _split_sql(field: str) -> str:
    return f"SELECT row_id, unnest(list_transform(string_split({field}, ';'), lambda x: trim(x))) AS item, generate_subscripts(string_split({field}, ';'), 1) AS pos FROM r WHERE {field} IS NOT NULL"


@query(f"""WITH {_R}, i AS ({_SQL["record_institutions"]}), a AS ({_list_items("Keywords", 3, f"SELECT row_id, pos, lower(item) AS item FROM ({_split_sql('author_keywords')})")} UNION ALL {_list_items("Authors", 3, _split_sql("authors"))}
  UNION ALL {_list_items("Institutions", 1, "SELECT row_id, unnest(string_split(institutions, '; ')) AS item, generate_subscripts(string_split(institutions, '; '), 1) AS pos FROM i WHERE institutions <> ''")}),
k(network, least, links, most) AS (VALUES {', '.join(f"('{n}', {a}, {b}, {c})" for n, (a, b, c) in _NETWORK_LIMITS.items())}),
f AS (SELECT network, item, count(*) AS freq FROM a GROUP BY ALL), z AS (SELECT f.* FROM (SELECT *, row_number() OVER (PARTITION BY network ORDER BY freq DESC, item) AS nth FROM f) f JOIN k USING (network) WHERE nth <= most AND freq >= least),
u AS (SELECT a.* FROM a JOIN z USING (network, item))
SELECT network, x.item AS src, y.item AS dst, count(*) AS weight FROM u x JOIN u y USING (network, row_id) JOIN k USING (network) WHERE x.item < y.item OR (x.item = y.item AND x.pos < y.pos) GROUP BY network, x.item, y.item, links HAVING count(*) >= links""")
def network_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the keyword, author and institution networks of the export, each at its limits."""
    from quillspark.plans import modules

    return modules.network_lines(modules.network_items(records(spark, sf_dir)), _NETWORK_LIMITS).select("network", "src", "dst", "weight")


@query(f"""WITH {_R}, i AS ({_SQL["record_institutions"]}), x AS (SELECT row_id, unnest(string_split(institutions, '; ')) AS inst FROM i WHERE institutions <> ''),
p AS (SELECT inst, count(*) AS docs, sum(coalesce(TRY_CAST(cited_by AS DOUBLE), 0)) AS tc FROM x JOIN r USING (row_id) GROUP BY 1), s AS (SELECT * FROM p WHERE inst IN {_in(["University of Toronto", "University of Washington", "Harvard Medical School", "Stanford University", "Massachusetts Institute of Technology (MIT)", "Imperial College London", "Københavns Universitet", "Rigshospitalet"])}),
m AS (SELECT * FROM p ORDER BY docs DESC, tc DESC, inst LIMIT 20)
SELECT inst AS institution, docs AS documents, CAST(tc AS BIGINT) AS citations, round(tc / docs, 2) AS cpp FROM (SELECT * FROM m UNION SELECT * FROM s)""")
def institution_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.plans import modules

    return modules.institution_table(modules.prepared(records(spark, sf_dir))).toDF("institution", "documents", "citations", "cpp")


@query(f"""WITH {_R}, n AS (SELECT row_id, pos, lower(trim(x)) AS item FROM (SELECT row_id, unnest(string_split(author_keywords, ';')) AS x, generate_subscripts(string_split(author_keywords, ';'), 1) AS pos FROM r WHERE author_keywords IS NOT NULL) WHERE length(trim(x)) >= 3),
m AS (SELECT DISTINCT row_id, CASE item {" ".join(f"WHEN '{_quoted(k)}' THEN '{_quoted(v)}'" for k, v in lx.KEYWORD_MAP.items())} ELSE item END AS item FROM n),
j AS (SELECT row_id, lower(trim(x)) AS item FROM (SELECT row_id, unnest(string_split(index_keywords, ';')) AS x FROM r WHERE index_keywords IS NOT NULL) WHERE length(trim(x)) >= 3),
o AS (SELECT CASE item {" ".join(f"WHEN '{_quoted(k)}' THEN '{_quoted(v)}'" for k, v in lx.INDEX_KEYWORD_MAP.items())} ELSE item END AS item FROM j),
a AS (SELECT item AS w, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, item) AS rank FROM m GROUP BY 1 QUALIFY rank <= 10), b AS (SELECT item AS w, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, item) AS rank FROM o GROUP BY 1 QUALIFY rank <= 10)
SELECT rank, coalesce(a.w, '') AS author_keyword, coalesce(a.n, 0) AS author_n, coalesce(b.w, '') AS index_keyword, coalesce(b.n, 0) AS index_n FROM a FULL JOIN b USING (rank)""")
def keyword_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author keywords, once a record and by the fixed table, beside every occurrence of index keywords."""
    rows = records(spark, sf_dir)
    left = keywords.top_keywords(rows, entities.mapped_keywords(entities.keywords("Author Keywords")))
    right = keywords.top_keywords(rows, F.transform(entities.keywords("Index Keywords"), lambda w: entities.lookup(lx.INDEX_KEYWORD_MAP, w)))
    return keywords.rank_aligned(left, right).toDF("rank", "author_keyword", "author_n", "index_keyword", "index_n")


# Streams


@query("""WITH k AS (SELECT event_id, user_id || '/' || event_type AS k, value FROM events)
SELECT event_id, k, value FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY value DESC, event_id) = 1""")
def stream_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The richest event of each user and type, kept by a stateful stream over the files of ``events``."""
    from quillspark.streaming import survivors

    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, so that the table may be a file or a folder
    keyed = events.select("event_id", F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("k"), "value", F.col("ts").cast("timestamp").alias("ts"))
    path, store = graph.shared_path(spark), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, survivors.STATE_STORE)
    try:
        kept = survivors.survivors(keyed, "k", F.col("value"), "event_id", "ts", delay="3650 days", idle="3650 days")
        writing = kept.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
        writing.awaitTermination()
    finally:
        spark.conf.unset(store) if before is None else spark.conf.set(store, before)
    return survivors.final(spark.read.parquet(f"{path}/rows"), "k", F.col("value"), "event_id").select("event_id", "k", "value")
