"""Embedding whitening: singular value decomposition of centred distributed rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored, table, without

SCALE = 256
COMPONENTS = 4
#: Singular values under this share of the largest are rounding of the Gramian, not components.
RANK_CONDITION = 1e-6
#: Dimensions up to which every component is asked for, so that the Gramian is decomposed whole; beyond, Lanczos steps over the rows.
MOST_DIMENSIONS = 15_000
EXACT = "decimal(38,0)"


@dataclass
class Whitening:
    """What ``fit`` has learned: ``n`` distinct vectors, their sums, the total variance, falling eigenvalues with unit eigenvectors, and how far whitened covariance is from the identity."""

    n: int
    sums: list[int]
    total_variance: float
    eigenvalues: list[float]
    components: list[list[float]]
    identity_error: float | None = None


def numbers(values: list, kind: str) -> Column:
    """A constant array of numbers, folded to one literal when the plan is optimised."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def scaled(df: DataFrame, column: str = "embedding", scale: int = SCALE) -> Column:
    """``floor(scale * c)`` of every entry as long; null where the vector is null or empty or holds null or non-finite entries. Past the range of long the nearest long is taken."""
    vector = F.col(f"`{column}`").cast("array<double>")
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.when(finite & (F.size(vector) > 0), F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c)))


def common_size(x: DataFrame) -> int:
    """The commonest length of the arrays ``x(x)``, the least of equally common ones; 0 without rows."""
    found = x.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return found[0]["d"] if found else 0


def deviation(x: Column, n: int, sums: list[int]) -> Column:
    """Sum over dimensions of (n x - S)^2, exact in decimals of 38 digits; null where even those don't hold it."""
    scaled_up = F.zip_with(x, numbers(sums, EXACT), lambda c, s: F.try_subtract(F.lit(n).cast("decimal(19,0)") * c.cast("decimal(19,0)"), s))
    return F.aggregate(scaled_up, F.lit(0).cast(EXACT), lambda total, y: F.try_add(total, F.try_multiply(y, y)))


def centred(x: Column, model_n: int, sums: list[int]) -> Column:
    return F.zip_with(x, numbers([s / model_n for s in sums], "double"), lambda c, m: c.cast("double") - m)


def projections(x: Column, model: Whitening) -> Column:
    """The whitened coordinates of a long vector."""
    middle = centred(x, model.n, model.sums)
    dot = lambda v: F.aggregate(F.zip_with(middle, numbers(v, "double"), lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)
    return F.array(*[dot(v) / F.lit(e**0.5) for v, e in zip(model.components, model.eigenvalues, strict=True)]).cast("array<double>")


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Learn from ``x(x)``, arrays of long of one length, each distinct array once; None without rows.

    Sums and deviations are exact; the singular values of the centred rows,
    squared and divided by n, are the eigenvalues. Components whose variance is
    rounding only are left out, so constant vectors have none. What reaches the
    driver has a row a dimension, or is the decomposition of the Gramian.
    """
    distinct = stored(x.select("x").distinct())
    n = distinct.count()
    if not n:
        discard(distinct)
        return None
    each = distinct.select(F.posexplode("x").alias("d", "c")).groupBy("d").agg(F.sum(F.col("c").cast("decimal(19,0)")).alias("s"))
    sums = [int(r["s"]) for r in each.orderBy("d").collect()]
    deviations = distinct.agg(F.try_sum(deviation(F.col("x"), n, sums)).alias("exact"), F.count(deviation(F.col("x"), n, sums)).alias("held")).first()
    exact = int(deviations["exact"]) if deviations["exact"] is not None and deviations["held"] == n else None
    model = Whitening(n, sums, 0.0, [], [])
    if exact != 0:
        rows = MLUtils.convertVectorColumnsFromML(distinct.select(array_to_vector(centred(F.col("x"), n, sums)).alias("v")), "v")
        d = len(sums)
        found = RowMatrix(rows, n, d).computeSVD(d if d <= MOST_DIMENSIONS else components, computeU=False, rCond=RANK_CONDITION)
        values = [float(s) ** 2 / n for s in found.s.toArray()]
        vectors = found.V.toArray().T.tolist()
        kept = [i for i, e in enumerate(values) if e > 0][:components]
        # the squares of n x - S are n^2 times those of x - S/n, and the covariance divides by n once more
        model.total_variance = exact / n**3 if exact is not None else sum(values)
        model.eigenvalues, model.components = [values[i] for i in kept], [vectors[i] for i in kept]
        k = len(kept)
        if k:
            white = distinct.select(projections(F.col("x"), model).alias("w"))
            pairs = [(i, j) for i in range(k) for j in range(i, k)]
            # covar_pop merges centred moments, so nothing is multiplied before it is centred
            moments = white.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
            model.identity_error = max(abs(moments[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    discard(distinct)
    return model


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> tuple[DataFrame, Whitening | None]:
    """All rows and columns of ``vectors`` with ``whitened`` (array of double) and ``deviation`` (decimal), and the model.

    Both are null where the vector is null, empty, holds null or non-finite
    entries or is not of the commonest length. Whitened coordinates go by
    falling eigenvalue; there are fewer than ``components`` where the distinct
    vectors vary in fewer directions. Repeated rows are fitted once and all
    returned; of equal eigenvalues any basis may come; an empty table, or one
    without a usable vector, has no model. Columns of ``vectors`` named
    ``whitened`` or ``deviation`` are replaced.
    """
    x = scaled(vectors, column, scale)
    usable = vectors.select(x.alias("x")).filter("x IS NOT NULL")
    d = common_size(usable)
    model = fit(usable.filter(F.size("x") == d), components) if d else None
    kept = without(vectors, "whitened", "deviation")
    if model is None:
        return kept.withColumns({"whitened": F.lit(None).cast("array<double>"), "deviation": F.lit(None).cast(EXACT)}), None
    mine = F.when(F.size(x) == d, x)
    return kept.withColumns({"whitened": F.when(mine.isNotNull(), projections(mine, model)), "deviation": deviation(mine, model.n, model.sums)}), model


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each usable vector and component."""
    found, model = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    n, error = (model.n, model.identity_error) if model else (0, None)
    explained = numbers([e / model.total_variance for e in model.eigenvalues], "double") if model and model.components else F.array().cast("array<double>")
    each = found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"),
        "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
