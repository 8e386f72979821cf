"""Weighted co-occurrence networks: edges, degrees, components, communities and their comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges that Louvain takes: the graphs after thresholds are small, and this is checked.
MAX_LOUVAIN_EDGES = 2_000_000


def frequencies(items: DataFrame, doc: str, item: str, distinct: bool = True) -> DataFrame:
    rows = items.select(doc, item).distinct() if distinct else items
    return rows.groupBy(F.col(item).alias("id")).agg(F.count(F.lit(1)).alias("freq"))


def eligible(nodes: DataFrame, min_freq: int, max_nodes: int | None = None) -> DataFrame:
    kept = nodes if max_nodes is None else nodes.orderBy(F.desc("freq"), F.asc("id")).limit(max_nodes)
    return kept.filter(F.col("freq") >= min_freq)


def pair_counts(items: DataFrame, doc: str, item: str, nodes: DataFrame, distinct: bool = True) -> DataFrame:
    """Documents in which two items occur together, ``src < dst``.

    Items are thinned to eligible ones before pairing, then gathered by
    document; the pairs of its sorted list are made in place, so there is one
    shuffle by document and one, after partial sums, by pair. With
    ``distinct=False`` every repeat counts and makes pairs with itself.
    """
    rows = items.select(doc, F.col(item).alias("id")).join(nodes.select("id"), "id", "left_semi")
    gathered = (F.collect_set if distinct else F.collect_list)("id")
    lists = rows.groupBy(doc).agg(F.sort_array(gathered).alias("ids")).filter(F.size("ids") > 1)
    pairs = F.flatten(F.transform("ids", lambda a, i: F.transform(F.slice("ids", i + 2, F.size("ids")), lambda b: F.struct(a.alias("src"), b.alias("dst")))))
    return lists.select(F.explode(pairs).alias("p")).groupBy("p.src", "p.dst").agg(F.count(F.lit(1)).alias("weight"))


def network(items: DataFrame, doc: str, item: str, min_freq: int, min_edge: int, max_nodes: int | None = None, distinct: bool = True) -> tuple[DataFrame, DataFrame]:
    """Eligible nodes (isolated ones included) and the edges that reach ``min_edge``."""
    nodes = eligible(frequencies(items, doc, item, distinct), min_freq, max_nodes)
    return nodes, pair_counts(items, doc, item, nodes, distinct).filter(F.col("weight") >= min_edge)


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id"), "weight").unionByName(edges.select(F.col("dst").alias("id"), "weight"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


def shown_labels(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """The k linked nodes ``(id, degree, freq)`` that a drawing names: by degree, then by frequency, then by id."""
    return degrees(edges).join(nodes, "id").orderBy(F.desc("degree"), F.desc("freq"), "id").limit(k).select("id", "degree", "freq")


def size_and_density(edges: DataFrame) -> DataFrame:
    """One row: linked nodes, edges, density."""
    plain = edges.filter("src <> dst")
    counted = degrees(plain).agg(F.count(F.lit(1)).alias("nodes")).crossJoin(plain.agg(F.count(F.lit(1)).alias("edges")))  # one row each
    return counted.withColumn("density", F.when(F.col("nodes") > 1, 2.0 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0))


def shared_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder; only a local master may do without a named one."""
    master = spark.sparkContext.master
    if not spark.sparkContext.getCheckpointDir():
        import tempfile

        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not named and (not master.startswith("local") or master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="quillspark-"))
    return spark.sparkContext.getCheckpointDir()


def shared_path(spark: SparkSession) -> str:
    """A path for a table in the shared folder, deleted when the session ends."""
    import uuid

    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, its lineage cut."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)``: the least id that links reach.

    Labels spread along edges and jump to their label's label, so rounds grow
    with the logarithm of a chain's length; each round is checkpointed.
    """
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other")))
    both = checkpointed(both.filter("id <> other").distinct())
    labels = checkpointed(both.groupBy("id").agg(F.min("other").alias("o")).select("id", F.least("id", "o").alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("other"), "component"), "other").groupBy("id").agg(F.min("component").alias("c"))
        stepped = labels.join(near, "id").select("id", F.least("component", "c").alias("n"), F.col("component").alias("was"))
        up = stepped.select(F.col("id").alias("n"), F.col("n").alias("nn"))
        jumped = checkpointed(stepped.join(up, "n", "left").select("id", F.least("n", F.coalesce("nn", "n")).alias("component"), "was"))
        if jumped.filter("component <> was").isEmpty():
            return jumped.select("id", "component")
        labels = jumped.select("id", "component")


def largest_component(edges: DataFrame) -> DataFrame:
    """The edges of the component with most nodes, the one with the least id of equal ones."""
    member = components(edges)
    best = member.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("component")).limit(1)
    return edges.join(member.join(best, "component", "left_semi").select(F.col("id").alias("src")), "src", "left_semi")


def louvain_labels(edges: list[tuple[str, str, float]], resolution: float = 1.0) -> dict[str, int]:
    """Louvain communities of a weighted graph, nodes in sorted order; labels by size, then least node."""
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    of = {n: i for i, n in enumerate(nodes)}
    member = list(range(len(nodes)))
    graph: list[dict[int, float]] = [{} for _ in nodes]
    for a, b, w in edges:
        i, j = of[a], of[b]
        graph[i][j] = graph[i].get(j, 0.0) + w
        if i != j:
            graph[j][i] = graph[j].get(i, 0.0) + w
    total = sum(w * (2 if a != b else 1) for a, b, w in edges) or 1.0
    while True:
        strength = [sum(g.values()) + g.get(i, 0.0) for i, g in enumerate(graph)]
        m2 = sum(strength) or total
        group = list(range(len(graph)))
        filled = strength[:]
        moved_any, moved = False, True
        while moved:
            moved = False
            for i, links in enumerate(graph):
                to: dict[int, float] = {}
                for j, w in links.items():
                    if j != i:
                        to[group[j]] = to.get(group[j], 0.0) + w
                old = group[i]
                filled[old] -= strength[i]
                gain = lambda g, i=i, to=to: to.get(g, 0.0) - resolution * strength[i] * filled[g] / m2
                best, most = old, gain(old)
                for g in sorted(to):
                    if gain(g) > most + 1e-12:
                        best, most = g, gain(g)
                filled[best] += strength[i]
                if best != old:
                    group[i], moved, moved_any = best, True, True
        if not moved_any:
            break
        names = {g: n for n, g in enumerate(sorted(set(group)))}
        merged: list[dict[int, float]] = [{} for _ in names]
        for i, links in enumerate(graph):
            a = names[group[i]]
            for j, w in links.items():
                b = names[group[j]]
                if i == j:
                    merged[a][a] = merged[a].get(a, 0.0) + w
                elif a == b:
                    merged[a][a] = merged[a].get(a, 0.0) + w / 2
                else:
                    merged[a][b] = merged[a].get(b, 0.0) + w
        member = [names[group[c]] for c in member]
        graph = merged
    held: dict[int, list[str]] = {}
    for n, c in zip(nodes, member, strict=True):
        held.setdefault(c, []).append(n)
    order = sorted(held.values(), key=lambda v: (-len(v), v[0]))
    return {n: c for c, v in enumerate(order) for n in v}


def louvain(edges: DataFrame, graph: str | None = None, resolution: float = 1.0) -> DataFrame:
    """``(id, cluster)`` of one graph, or of each named by a column; a graph is one task, within a checked size."""
    import pandas as pd

    keyed = edges.withColumn("_graph", F.lit("") if graph is None else F.col(graph).cast("string"))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > MAX_LOUVAIN_EDGES:
            raise ValueError(f"a graph has more than {MAX_LOUVAIN_EDGES} edges: raise the thresholds")
        labels = louvain_labels(list(zip(frame["src"], frame["dst"], frame["weight"].astype(float), strict=True)), resolution)
        return pd.DataFrame({"_graph": frame["_graph"].iloc[0], "id": list(labels), "cluster": list(labels.values())})

    out = keyed.select("_graph", "src", "dst", "weight").groupBy("_graph").applyInPandas(one, "_graph string, id string, cluster long")
    return out.drop("_graph") if graph is None else out.withColumnRenamed("_graph", graph)


#: Passes over the nodes of a level, and what a pass must add to the modularity for another one.
MOST_PASSES, LEAST_GAIN = 6, 1e-3


def _pass(links: DataFrame, nodes: DataFrame, m2: float, turn: int, resolution: float) -> DataFrame:
    """``nodes(id, k, c)`` after each has moved to the neighbouring community of most gain, if it is this turn's.

    A hash of node and turn picks about half of the nodes, so that neighbours
    seldom trade places at once; gains are sums by node and community.
    """
    weights = links.join(nodes.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id"), "c").agg(F.sum("w").alias("w"))
    own = nodes.select("id", "c", F.lit(0.0).alias("w"))
    tried = weights.unionByName(own).groupBy("id", "c").agg(F.sum("w").alias("w"))
    filled = nodes.groupBy("c").agg(F.sum("k").alias("filled"))
    known = tried.join(filled, "c").join(nodes.select("id", "k", F.col("c").alias("own")), "id")
    gain = F.col("w") - resolution * F.col("k") * (F.col("filled") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / m2
    best = known.withColumn("gain", gain).groupBy("id", "k", "own").agg(F.min_by(F.struct("c", "gain"), F.struct(-F.col("gain"), "c")).alias("best"), F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay"))
    goes = (F.pmod(F.xxhash64("id", F.lit(turn // 2)), F.lit(2)) == turn % 2) & (F.col("best.gain") > F.col("stay") + 1e-12)
    return best.select("id", "k", F.when(goes, F.col("best.c")).otherwise(F.col("own")).alias("c"))


def _quality_of(links: DataFrame, loops: DataFrame, nodes: DataFrame, m2: float, resolution: float) -> float:
    place = nodes.select("id", "c")
    inside = links.join(place.select(F.col("id").alias("a"), F.col("c").alias("x")), "a").join(place.select(F.col("id").alias("b"), F.col("c").alias("y")), "b").filter("x = y").agg(F.sum("w")).first()[0] or 0.0
    looped = loops.agg(F.sum("w")).first()[0] or 0.0
    squares = nodes.groupBy("c").agg(F.sum("k").alias("d")).agg(F.sum(F.pow(F.col("d") / m2, 2))).first()[0] or 0.0
    return (inside + 2 * looped) / m2 - resolution * squares


def communities(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """``(id, cluster)`` of a weighted graph of any size, by local moves and contraction; ``cluster`` is the least id in it.

    Levels as in Louvain's method, but every step is an aggregate or a join:
    the nodes of a turn move together by the gains of the last state, and the
    best state of a level's passes goes on. A level's communities become the
    nodes of the next by summing their links. States are written to the shared
    folder. Moves at once make the result differ from that of one node after
    another; modularity stays close to it (a test holds them together).
    """
    plain = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(F.col("weight").cast("double")).alias("w"))
    whole = checkpointed(plain)
    member = None
    while True:
        loops = whole.filter("a = b")
        half = whole.filter("a <> b")
        links = checkpointed(half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
        ends = links.select(F.col("a").alias("id"), "w").unionByName(loops.select(F.col("a").alias("id"), (2 * F.col("w")).alias("w")))
        nodes = checkpointed(ends.groupBy("id").agg(F.sum("w").alias("k")).withColumn("c", F.col("id")))
        m2 = nodes.agg(F.sum("k")).first()[0] or 0.0
        if not m2:
            break
        best, most, begun = nodes, (before := _quality_of(links, loops, nodes, m2, resolution)), before
        for turn in range(0, 2 * MOST_PASSES, 2):
            nodes = checkpointed(_pass(links, checkpointed(_pass(links, nodes, m2, turn, resolution)), m2, turn + 1, resolution))
            reached = _quality_of(links, loops, nodes, m2, resolution)
            if reached > most:
                best, most = nodes, reached
            if reached - before < LEAST_GAIN:
                break
            before = reached
        if most - begun < LEAST_GAIN:
            break
        place = best.select("id", "c")
        member = checkpointed(place if member is None else member.join(place.select(F.col("id").alias("c"), F.col("c").alias("up")), "c").select("id", F.col("up").alias("c")))
        named = lambda end, place=place: place.select(F.col("id").alias(end), F.col("c").alias(f"c{end}"))
        merged = whole.join(named("a"), "a").join(named("b"), "b").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w"))
        whole = checkpointed(merged)
    if member is None:
        member = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("c", F.col("id"))
    return member.join(member.groupBy("c").agg(F.min("id").alias("cluster")), "c").select("id", "cluster")


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: weighted modularity of a partition ``(id, cluster)``."""
    placed = edges.join(labels.select(F.col("id").alias("src"), F.col("cluster").alias("cs")), "src").join(labels.select(F.col("id").alias("dst"), F.col("cluster").alias("cd")), "dst")
    ends = placed.select(F.col("cs").alias("c"), "weight").unionByName(placed.select(F.col("cd").alias("c"), "weight"))
    strength = ends.groupBy("c").agg(F.sum("weight").alias("d"))
    inside = placed.filter("cs = cd").groupBy(F.col("cs").alias("c")).agg(F.sum("weight").alias("w"))
    m = placed.agg(F.sum("weight").cast("double").alias("m"))
    parts = strength.join(inside, "c", "left").crossJoin(F.broadcast(m))  # one row
    return parts.agg(F.sum(F.coalesce("w", F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("modularity"))


def adjusted_rand(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: adjusted Rand index of two partitions ``(id, cluster)`` on their shared ids; 1 where both are trivial."""
    table = a.select("id", F.col("cluster").alias("x")).join(b.select("id", F.col("cluster").alias("y")), "id").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda df, n: df.agg(F.sum(F.col(n) * (F.col(n) - 1) / 2).alias("v"))
    both = pairs(table, "n").select(F.col("v").alias("s"))
    rows = pairs(table.groupBy("x").agg(F.sum("n").alias("n")), "n").select(F.col("v").alias("r"))
    columns = pairs(table.groupBy("y").agg(F.sum("n").alias("n")), "n").select(F.col("v").alias("c"))
    total = table.agg(F.sum("n").alias("t"))
    one = both.crossJoin(rows).crossJoin(columns).crossJoin(total)  # one row each
    expected = F.col("r") * F.col("c") / (F.col("t") * (F.col("t") - 1) / 2)
    most = (F.col("r") + F.col("c")) / 2
    return one.select(F.when(most == expected, F.lit(1.0)).otherwise((F.col("s") - expected) / (most - expected)).alias("ari"))


def sensitivity(items: DataFrame, doc: str, item: str, grid: list[tuple[int, int]]) -> DataFrame:
    """Nodes, linked nodes, edges and density for every (min_freq, min_edge).

    Frequencies and pairs are counted once, at the loosest thresholds; each
    configuration is a filter on those counts.
    """
    spark = items.sparkSession
    params = F.broadcast(spark.createDataFrame([tuple(g) for g in grid], "min_freq long, min_edge long"))  # as many rows as configurations
    nodes = checkpointed(eligible(frequencies(items, doc, item), min(f for f, _ in grid)))
    edges = pair_counts(items, doc, item, nodes).filter(F.col("weight") >= min(e for _, e in grid))
    known = edges.join(nodes.select(F.col("id").alias("src"), F.col("freq").alias("fs")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("freq").alias("fd")), "dst")
    fit = known.crossJoin(params).filter("weight >= min_edge and fs >= min_freq and fd >= min_freq")
    ends = fit.select("min_freq", "min_edge", F.explode(F.array("src", "dst")).alias("id")).distinct().groupBy("min_freq", "min_edge").agg(F.count(F.lit(1)).alias("linked"))
    links = fit.groupBy("min_freq", "min_edge").agg(F.count(F.lit(1)).alias("edges"))
    sizes = nodes.crossJoin(params).filter("freq >= min_freq").groupBy("min_freq", "min_edge").agg(F.count(F.lit(1)).alias("nodes"))
    out = params.join(sizes, ["min_freq", "min_edge"], "left").join(ends, ["min_freq", "min_edge"], "left").join(links, ["min_freq", "min_edge"], "left").fillna(0)
    return out.withColumn("density", F.when(F.col("linked") > 1, 2.0 * F.col("edges") / (F.col("linked") * (F.col("linked") - 1))).otherwise(0.0))


def matrix(items: DataFrame, doc: str, item: str, k: int = 10, order: str | None = None) -> DataFrame:
    """Co-occurrence of the k most frequent items as (row, column, n), symmetric; the diagonal is document frequency.

    Of equally frequent items the first seen in ``order`` (a column of
    ``items``) is among the k, or the first by name without one.
    """
    top = frequencies(items, doc, item)
    if order:
        top = top.join(items.groupBy(F.col(item).alias("id")).agg(F.min(order).alias("_first")), "id").orderBy(F.desc("freq"), F.asc("_first")).limit(k).drop("_first")
    else:
        top = top.orderBy(F.desc("freq"), F.asc("id")).limit(k)
    pairs = pair_counts(items, doc, item, top)
    turned = pairs.select(F.col("dst").alias("row"), F.col("src").alias("column"), F.col("weight").alias("n"))
    return pairs.select(F.col("src").alias("row"), F.col("dst").alias("column"), F.col("weight").alias("n")).unionByName(turned).unionByName(top.select(F.col("id").alias("row"), F.col("id").alias("column"), F.col("freq").alias("n")))


def spanning_forest(edges: DataFrame, graph: str = "graph") -> DataFrame:
    """The edges ``(graph, src, dst, weight)`` of a maximum spanning forest of each graph.

    Rounds: every component takes its best edge out of it, by weight, then by
    ends, an order in which no two edges are equal, so that chosen edges close
    no ring; components that an edge joins become one, by ``components``. Each
    round at least halves the components that have an edge left. Rounds are
    written tables; the edges within a component go as soon as it forms.
    """
    left = checkpointed(edges.filter("src <> dst").groupBy(F.col(graph).alias("graph"), F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias("weight")))
    left = left.select("*", F.col("src").alias("a"), F.col("dst").alias("b"))
    kept = []
    while not left.isEmpty():
        ends = left.unionByName(left.withColumns({"a": F.col("b"), "b": F.col("a")}))
        rank = F.struct(-F.col("weight"), "src", "dst")
        best = ends.groupBy("graph", "a").agg(F.min_by(F.struct("src", "dst", "weight", "b"), rank).alias("e"))
        chosen = checkpointed(best.select("graph", "a", "e.b", "e.src", "e.dst", "e.weight"))
        kept.append(chosen.select("graph", "src", "dst", "weight").distinct())
        joined = components(chosen.select(F.struct("graph", F.col("a").alias("id")).alias("src"), F.struct("graph", F.col("b").alias("id")).alias("dst")))
        root = joined.select("id.graph", F.col("id.id").alias("a"), F.col("component.id").alias("r"))
        moved = left.join(root, ["graph", "a"]).withColumn("a", F.col("r")).drop("r").join(root.withColumnRenamed("a", "b"), ["graph", "b"]).withColumn("b", F.col("r")).drop("r")
        left = checkpointed(moved.filter("a <> b").select("graph", "src", "dst", "weight", "a", "b"))
    out = edges.select(F.col(graph).alias("graph"), "src", "dst", "weight").limit(0)
    for part in kept:
        out = out.unionByName(part)
    return out.withColumnRenamed("graph", graph)


def forest_components(forest: DataFrame, thresholds: DataFrame, graph: str = "graph") -> DataFrame:
    """``(config, id, component)``: the components that edges of at least a weight make, for every row ``(config, graph, least)`` of ``thresholds``.

    They are those of the forest's edges of that weight, so the graph's other
    edges are not looked at; all thresholds take the same rounds together.
    """
    cut = forest.join(F.broadcast(thresholds), graph).filter("weight >= least")  # a row for each configuration
    named = lambda c: F.struct("config", F.col(c).alias("id"))
    found = components(cut.select(named("src").alias("src"), named("dst").alias("dst")))
    return found.select("id.config", "id.id", F.col("component.id").alias("component"))


def community_grid(items: DataFrame, doc: str, item: str, grid: list[tuple[int, int]], baseline: tuple[int, int]) -> DataFrame:
    """Communities, modularity and agreement with the baseline's communities for every (min_freq, min_edge).

    Pairs are counted once; each configuration's graph is one Louvain task.
    Agreement is the adjusted Rand index on shared linked nodes, null for fewer than two.
    """
    spark = items.sparkSession
    grid = sorted({*grid, baseline})
    params = F.broadcast(spark.createDataFrame([(f"{a}/{b}", a, b) for a, b in grid], "config string, min_freq long, min_edge long"))  # a row for each configuration
    nodes = eligible(frequencies(items, doc, item), min(f for f, _ in grid))
    edges = pair_counts(items, doc, item, nodes).filter(F.col("weight") >= min(e for _, e in grid))
    known = edges.join(nodes.select(F.col("id").alias("src"), F.col("freq").alias("fs")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("freq").alias("fd")), "dst")
    fit = checkpointed(known.crossJoin(params).filter("weight >= min_edge and fs >= min_freq and fd >= min_freq").select("config", "src", "dst", "weight"))
    measured = community_measures(fit, f"{baseline[0]}/{baseline[1]}")
    return params.join(measured, "config", "left").select("min_freq", "min_edge", F.coalesce("communities", F.lit(0)).alias("communities"), "modularity", "ari")


def community_measures(fit: DataFrame, baseline: str) -> DataFrame:
    """``(config, communities, modularity, ari)`` of the graphs ``fit(config, src, dst, weight)``, stored; agreement is with the baseline's communities."""
    labels = checkpointed(louvain(fit, "config"))
    placed = fit.join(labels.select("config", F.col("id").alias("src"), F.col("cluster").alias("cs")), ["config", "src"]).join(labels.select("config", F.col("id").alias("dst"), F.col("cluster").alias("cd")), ["config", "dst"])
    ends = placed.select("config", F.explode(F.array("cs", "cd")).alias("c"), "weight").groupBy("config", "c").agg(F.sum("weight").alias("d"))
    inside = placed.filter("cs = cd").groupBy("config", F.col("cs").alias("c")).agg(F.sum("weight").alias("w"))
    whole = placed.groupBy("config").agg(F.sum("weight").cast("double").alias("m"))
    parts = ends.join(inside, ["config", "c"], "left").join(whole, "config")
    quality = parts.groupBy("config").agg(F.count(F.lit(1)).alias("communities"), F.sum(F.coalesce("w", F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("modularity"))
    base = labels.filter(F.col("config") == baseline).select("id", F.col("cluster").alias("y"))
    table = labels.select("config", "id", F.col("cluster").alias("x")).join(base, "id").groupBy("config", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    chosen = lambda df, name: df.groupBy("config").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias(name))
    sums = chosen(table, "s").join(chosen(table.groupBy("config", "x").agg(F.sum("n").alias("n")), "r"), "config").join(chosen(table.groupBy("config", "y").agg(F.sum("n").alias("n")), "c"), "config")
    counted = sums.join(table.groupBy("config").agg(F.sum("n").alias("t")), "config").filter("t >= 2")
    expected, most = F.col("r") * F.col("c") / (F.col("t") * (F.col("t") - 1) / 2), (F.col("r") + F.col("c")) / 2
    agreement = counted.select("config", F.when(most == expected, F.lit(1.0)).otherwise((F.col("s") - expected) / (most - expected)).alias("ari"))
    return quality.join(agreement, "config", "left")


def component_grid(edges: DataFrame, grid: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """The graphs ``(config, src, dst, weight)`` of every (min_freq, min_edge), and of each node its component.

    ``edges(src, dst, weight, fs, fd)`` are counted at the loosest thresholds;
    a spanning forest for each least frequency serves all least weights.
    """
    spark = edges.sparkSession
    configs = spark.createDataFrame([(f"{f}/{e}", f, e) for f, e in grid], "config string, graph long, least long")
    by_frequency = edges.join(F.broadcast(configs.select("graph").distinct()), (F.col("fs") >= F.col("graph")) & (F.col("fd") >= F.col("graph"))).select("graph", "src", "dst", "weight")
    graphs = checkpointed(by_frequency.join(F.broadcast(configs), "graph").filter("weight >= least").select("config", "src", "dst", "weight"))
    return graphs, checkpointed(forest_components(spanning_forest(by_frequency), configs))


def largest_component_grid(items: DataFrame, doc: str, item: str, grid: list[tuple[int, int]], baseline: tuple[int, int], max_nodes: int = 70) -> DataFrame:
    """Size, density, communities, modularity and agreement of the largest component for every (min_freq, min_edge).

    Frequencies and pairs are counted once, repeats included; components are
    cuts of a spanning forest. ``max_nodes`` bounds every graph to its square
    of edges, so each graph's communities are a small task of their own.
    """
    spark = items.sparkSession
    grid = sorted({*grid, baseline})
    params = F.broadcast(spark.createDataFrame([(f"{a}/{b}", a, b) for a, b in grid], "config string, min_freq long, min_edge long"))  # a row for each configuration
    nodes = checkpointed(eligible(frequencies(items, doc, item, False), min(f for f, _ in grid), max_nodes))
    edges = pair_counts(items, doc, item, nodes, False).filter(F.col("weight") >= min(e for _, e in grid))
    known = checkpointed(edges.join(nodes.select(F.col("id").alias("src"), F.col("freq").alias("fs")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("freq").alias("fd")), "dst"))
    graphs, placed = component_grid(known, grid)
    sizes = placed.groupBy("config", "component").agg(F.count(F.lit(1)).alias("nodes"))
    most = sizes.groupBy("config").agg(F.max("nodes").alias("nodes"))
    largest = sizes.join(most, ["config", "nodes"]).groupBy("config", "nodes").agg(F.min("component").alias("component"))  # the least of equally large ones
    member = placed.join(largest, ["config", "component"], "left_semi").select("config", F.col("id").alias("src"))
    fit = checkpointed(graphs.join(member, ["config", "src"], "left_semi"))
    links = fit.groupBy("config").agg(F.count(F.lit(1)).alias("edges"))
    measured = largest.select("config", "nodes").join(links, "config").join(community_measures(fit, f"{baseline[0]}/{baseline[1]}"), "config", "left")
    density = F.when(F.col("nodes") > 1, 2.0 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0)
    out = params.join(measured, "config", "left").fillna(0, ["nodes", "edges", "communities"])
    return out.select("min_freq", "min_edge", "nodes", "edges", F.coalesce(density, F.lit(0.0)).alias("density"), "communities", "modularity", "ari")
