"""Exact order statistics and quantiles of groups of any size.

Selection by refinement of value ranges: each round counts a group's values in
``BUCKETS`` parts of the range that holds the wanted rank (a partial aggregate),
and the part that holds it is the next range, with the least and the greatest value
found there as its borders.  A range of at most ``SMALL`` values is gathered and
sorted.  No group is sorted, gathered or windowed whole; the values, with their
groups, are written once to the shared scratch folder and read in each round.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import scratch_path

BUCKETS = 1024
SMALL = 10_000
#: Ratio of a range's borders beyond which its parts are equal in the logarithm.
WIDE = 1024
#: Groups or ranges that are broadcast; more of them are joined as the planner sees fit.
FEW = 100_000


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= FEW else df


def _bucket(buckets: int) -> Column:
    """A number that never falls as the value rises: the sign where a range has both
    (zero apart), equal steps of the logarithm where it is wide, equal steps else."""
    raw, (v, lo, hi) = F.col("v"), (F.col(c).cast("double") for c in ("v", "lo", "hi"))

    def steps(x: Column, least: Column, most: Column) -> Column:
        part = F.floor((x - least) / F.nullif(most - least, F.lit(0.0)) * buckets)
        # borders that are equal as doubles: the least value, and the others
        return F.coalesce(F.greatest(F.least(part, F.lit(buckets - 1)), F.lit(0)), (raw > F.col("lo")).cast("long"))

    def log(x: Column) -> Column:
        return F.ln(F.abs(x)) * F.signum(x)
    mixed = (lo <= 0) & (hi >= 0)
    wide = F.greatest(F.abs(lo), F.abs(hi)) / WIDE > F.least(F.abs(lo), F.abs(hi))
    return F.when(mixed, F.signum(v).cast("long")).when(wide, steps(F.when(v != 0, log(v)), log(lo), log(hi))) \
        .otherwise(steps(v / 2, lo / 2, hi / 2))  # halves: any width is finite


def _select(values: DataFrame, targets: DataFrame, small: int, buckets: int) -> DataFrame:
    """(g, rank, value) for targets (g, rank, at, lo, hi, c): the value at place
    ``at`` among the ``c`` values of group ``g`` between ``lo`` and ``hi``."""
    is_open = (F.col("lo") < F.col("hi")) & (F.col("c") > small)
    while True:
        targets = _kept(targets, "targets")
        active = targets.where(is_open)
        ranges = active.select("g", "lo", "hi").distinct()
        n = ranges.count()
        if not n:
            break
        counted = (values.join(_few(ranges, n), "g").where(F.col("v").between(F.col("lo"), F.col("hi")))
                   .groupBy("g", "lo", "hi", _bucket(buckets).alias("bucket"))
                   .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most")))
        # at most ``buckets`` rows for each range
        upto = F.sum("n").over(Window.partitionBy("g", "lo", "hi").orderBy("bucket"))
        parts = counted.withColumn("upto", upto)
        refined = active.drop("c").join(parts, ["g", "lo", "hi"]) \
            .where((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("n") <= F.col("at"))) \
            .select("g", "rank", (F.col("at") - F.col("upto") + F.col("n")).alias("at"), F.col("least").alias("lo"),
                    F.col("most").alias("hi"), F.col("n").alias("c"))
        targets = targets.where(~is_open).unionByName(refined)
    one = targets.where("lo = hi").select("g", "rank", F.col("lo").alias("value"))
    many = targets.where("lo < hi")
    ranges = many.select("g", "lo", "hi").distinct()
    gathered = (values.join(_few(ranges, ranges.count()), "g").where(F.col("v").between(F.col("lo"), F.col("hi")))
                .groupBy("g", "lo", "hi").agg(F.sort_array(F.collect_list("v")).alias("values")))
    return one.unionByName(many.join(gathered, ["g", "lo", "hi"])
                           .select("g", "rank", F.element_at("values", (F.col("at") + 1).cast("int")).alias("value")))


def quantiles(df: DataFrame, value: Column | str, by: list[str], qs: dict[str, float], small: int = SMALL,
              buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame, int]:
    """Interpolated quantiles (``name -> share``) of a numeric column for each group.

    Returns (``g``, ``n`` and a column for each quantile), the values (``g, v``; no
    nulls, no NaN) and the number of groups.  ``g`` is a struct of the ``by``
    columns; a null is a group value like any other."""
    v = F.col(value) if isinstance(value, str) else value
    group = F.struct(*[F.col(b) for b in by]) if by else F.struct(F.lit(0).alias("all"))
    values = df.select(group.alias("g"), v.alias("v")).where(F.col("v").isNotNull())
    if values.schema["v"].dataType.typeName() in ("double", "float"):
        values = values.where(~F.isnan("v"))
    values = _kept(values, "values")
    stats = _kept(values.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")),
                  "ranges")
    place = {name: (F.col("n") - 1) * F.lit(float(q)) for name, q in qs.items()}
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in place.values() for f in (F.floor, F.ceil)]))
    targets = stats.select("g", F.explode(ranks).alias("rank"), "lo", "hi", F.col("n").alias("c")) \
        .withColumn("at", F.col("rank"))
    found = _select(values, targets, small, buckets).groupBy("g").agg(
        F.map_from_entries(F.collect_list(F.struct("rank", F.col("value").cast("double")))).alias("at"))

    def between(p: Column) -> Column:
        low, high = F.col("at")[F.floor(p).cast("long")], F.col("at")[F.ceil(p).cast("long")]
        return low + (high - low) * (p - F.floor(p))
    out = stats.join(found, "g").select("g", "n", *[between(p).alias(name) for name, p in place.items()])
    return out, values, stats.count()


def box_statistics(df: DataFrame, value: Column | str, by: list[str], small: int = SMALL,
                   buckets: int = BUCKETS) -> DataFrame:
    """Box-plot statistics for each group: n, q1, median, q3 (linear interpolation
    between order statistics), the whiskers (most extreme values within 1.5 IQR of
    the box, never inside the box) and the number of outliers."""
    qs, values, groups = quantiles(df, value, by, {"q1": .25, "median": .5, "q3": .75}, small, buckets)
    iqr = F.col("q3") - F.col("q1")
    inside = (F.col("v") >= F.col("q1") - 1.5 * iqr) & (F.col("v") <= F.col("q3") + 1.5 * iqr)
    return (values.join(_few(qs, groups), "g").groupBy("g", "n", "q1", "median", "q3").agg(
        F.least(F.col("q1"), F.min(F.when(inside, F.col("v"))).cast("double")).alias("whisker_low"),
        F.greatest(F.col("q3"), F.max(F.when(inside, F.col("v"))).cast("double")).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"))
        .select(*[F.col("g")[b].alias(b) for b in by], "n", "q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers"))
