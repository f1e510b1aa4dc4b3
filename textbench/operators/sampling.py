"""Reproducible samples and splits.

Every draw orders rows by ``md5("<seed>|<doc_id>")`` with ``doc_id`` as tie
break, so the same rows come out on any cluster size and in the SQL oracle.

"The first n rows in key order" of a group are the rows up to a *cutoff*, the
(key, id) of its n-th row (:func:`cutoffs`).  The first four hex digits of the
key split every group into 65,536 buckets whose sizes are counted with a
partial aggregate; only the bucket that holds the n-th row is ranked, and the
cutoffs come to the driver, one row per group.  Drawing is then a comparison
of each row with its group's cutoff: no shuffle, no ``limit``, no window over
what is drawn, whatever the quota.  Callers pass few groups (dataset x label).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_HEX_DIGITS = 4  # 65,536 buckets per group


def sample_key(seed: int, id_col: str = "doc_id", salt: str | None = None) -> Column:
    prefix = str(seed) if salt is None else f"{seed}|{salt}"
    return F.md5(F.concat(F.lit(prefix), F.lit("|"), F.col(id_col).cast("string")))


def with_key(df: DataFrame, seed: int, salt: str | None = None, name: str = "sample_key") -> DataFrame:
    return df.withColumn(name, sample_key(seed, salt=salt))


def _bucket(key: Column) -> Column:
    return F.conv(F.substring(key, 1, BUCKET_HEX_DIGITS), 16, 10).cast("int")


def _quota_rows(df: DataFrame, by: list[str], quota) -> DataFrame:
    """One row (``by``, ``quota``) per group with a quota of its own."""
    if isinstance(quota, dict):
        schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by] + ["quota long"])
        return df.sparkSession.createDataFrame([(*g, int(n)) for g, n in quota.items()], schema)
    return quota.select(*by, F.col("quota").cast("long").alias("quota"))


def cutoffs(df: DataFrame, by: list[str], quota, key: str = "sample_key", id_col: str = "doc_id") -> DataFrame:
    """(``by``, ``_cut_key``, ``_cut_id``): the quota-th row of each group in
    (key, id) order, as a local table.  Groups with fewer rows than their quota
    have no cutoff (NULL: every row is within); groups without a quota or with
    a quota of zero are not listed (no row is within).

    ``quota``: an int for all groups, a dict (group tuple -> int) or a frame
    with the ``by`` columns and ``quota``."""
    spark = df.sparkSession
    keyed = df.select(*by, F.col(id_col).alias("_id"), F.col(key).alias("_key")).withColumn("_b", _bucket(F.col("_key")))
    counts = keyed.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("_cum", F.sum("_cnt").over(w))
    counts = (counts.withColumn("quota", F.lit(quota).cast("long")) if isinstance(quota, int)
              else counts.join(F.broadcast(_quota_rows(df, by, quota)), by))
    edge = (counts.where("quota > 0").groupBy(*by, "quota")
            .agg(F.min(F.when(F.col("_cum") >= F.col("quota"), F.struct("_b", (
                F.col("quota") - F.col("_cum") + F.col("_cnt")).alias("_need")))).alias("_e")).collect())
    schema = spark.createDataFrame([], ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
                                   + f", _cut_key string, _cut_id {df.schema[id_col].dataType.simpleString()}").schema
    full = [(*[r[c] for c in by], None, None) for r in edge if r["_e"] is None]
    bounds = [(*[r[c] for c in by], r["_e"]["_b"], r["_e"]["_need"]) for r in edge if r["_e"] is not None]
    ranked = []
    if bounds:
        b = spark.createDataFrame(bounds, ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
                                  + ", _b int, _need long")
        wr = Window.partitionBy(*by).orderBy("_key", "_id")
        ranked = (keyed.join(F.broadcast(b), [*by, "_b"]).withColumn("_r", F.row_number().over(wr))
                  .where(F.col("_r") == F.col("_need")).select(*by, "_key", "_id").collect())
    return spark.createDataFrame(full + [tuple(r) for r in ranked], schema)


def mark_first_n_by_key(df: DataFrame, by: list[str], quota, key: str = "sample_key", id_col: str = "doc_id",
                        flag: str = "_selected") -> DataFrame:
    """All rows of ``df`` plus a boolean ``flag``: TRUE when the row's rank in
    (``key``, ``id_col``) order within its ``by`` group is <= the quota.  One
    pass: the cutoffs, one row per group, are broadcast."""
    cut = cutoffs(df, by, quota, key, id_col).withColumn("_listed", F.lit(True))
    k, i = F.col(key), F.col(id_col)
    before = (k < F.col("_cut_key")) | ((k == F.col("_cut_key")) & (i <= F.col("_cut_id")))
    within = F.col("_listed") & (F.col("_cut_key").isNull() | before)
    return (df.join(F.broadcast(cut), by, "left").withColumn(flag, F.coalesce(within, F.lit(False)))
            .select(*df.columns, flag))


def first_n_by_key(df: DataFrame, by: list[str], quota, key: str = "sample_key",
                   id_col: str = "doc_id") -> DataFrame:
    """Rows of ``df`` whose rank in (``key``, ``id_col``) order within their
    ``by`` group is <= the quota (see :func:`mark_first_n_by_key`)."""
    return mark_first_n_by_key(df, by, quota, key, id_col).where("_selected").select(*df.columns)


def labelled(corpus: DataFrame) -> DataFrame:
    """Rows of class 0 or 1: no draw takes any other (unmapped labels are NULL)."""
    return corpus.where(F.col("label").isin(0, 1))


def rank_in_group(df: DataFrame, by: list[str], key: str = "sample_key", id_col: str = "doc_id",
                  name: str = "sample_rank") -> DataFrame:
    """Exact 1-based rank inside each group; use on bounded samples only."""
    w = Window.partitionBy(*by).orderBy(key, id_col)
    return df.withColumn(name, F.row_number().over(w))


def balanced_sample(corpus: DataFrame, sample_size: int = 1000, seed: int = 42, by: list[str] | None = None,
                    salt: str | None = None) -> DataFrame:
    """Per class (label 1 and label 0) ``min(sample_size // 2, class size)``
    rows without replacement; odd sizes lose one row.  Rows with any other
    label (NULL, unmapped) are never drawn."""
    by = list(by or ["dataset"])
    per_class = sample_size // 2
    return first_n_by_key(with_key(labelled(corpus), seed, salt), by + ["label"], per_class)


def simple_sample(corpus: DataFrame, n: int, seed: int = 42, by: list[str] | None = None,
                  salt: str | None = None) -> DataFrame:
    """``min(n, rows)`` labelled rows per group in key order (unbalanced)."""
    by = list(by or ["dataset"])
    return first_n_by_key(with_key(labelled(corpus), seed, salt), by, n)


def mark_test(corpus: DataFrame, sample_size: int, seed: int = 42, by: list[str] | None = None,
              flag: str = "_test") -> DataFrame:
    """Labelled rows with their ``sample_key`` and whether :func:`balanced_sample`
    draws them: the example pool is what is not drawn, without a join."""
    by = list(by or ["dataset"])
    return mark_first_n_by_key(with_key(labelled(corpus), seed), by + ["label"], sample_size // 2, flag=flag)


def example_pool(corpus: DataFrame, sample_size: int, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """Labelled rows outside the balanced test sample, with ``sample_key``."""
    return mark_test(corpus, sample_size, seed, by).where("NOT _test").drop("_test")


def exclude(df: DataFrame, taken: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Left anti join on the row key: everything not in ``taken``.  For an
    arbitrary ``taken``; a sample's own complement is :func:`example_pool`.
    Pass keys only, and attach texts to what is left."""
    keys = keys or ["dataset", "doc_id"]
    return df.join(taken.select(*keys).distinct(), keys, "left_anti")


def few_shot_examples(corpus: DataFrame, test: DataFrame | int, n_examples: int = 3, seed: int = 42,
                      by: list[str] | None = None) -> DataFrame:
    """The examples actually used for few-shot prompts: ``n_examples`` labelled
    rows outside the test set, in key order, with their rank ``example_rank``
    (1..n).  ``test``: the test rows, or the size of the balanced test sample.
    Groups with fewer rows get fewer examples; the grid turns that into an
    error result for the few-shot cells."""
    by = list(by or ["dataset"])
    pool = (example_pool(corpus, test, seed, by) if isinstance(test, int)
            else with_key(labelled(exclude(corpus, test, by + ["doc_id"])), seed))
    return rank_in_group(first_n_by_key(pool, by, n_examples), by, name="example_rank")


def sample_with_examples(corpus: DataFrame, sample_size: int, n_examples: int, seed: int = 42,
                         by: list[str] | None = None) -> DataFrame:
    """Test rows and few-shot examples in one frame: the drawn rows with
    ``sample_key``, ``_test`` and ``example_rank`` (NULL on test rows).  Two
    cutoffs and one pass; attach texts to it once, then divide it."""
    by = list(by or ["dataset"])
    marked = mark_test(corpus, sample_size, seed, by)
    pool = marked.where("NOT _test")
    cut = cutoffs(pool, by, n_examples).select(*by, F.col("_cut_key").alias("_k"), F.col("_cut_id").alias("_i"),
                                               F.lit(True).alias("_listed"))
    k, i = F.col("sample_key"), F.col("doc_id")
    within = F.col("_listed") & (F.col("_k").isNull() | (k < F.col("_k")) | ((k == F.col("_k")) & (i <= F.col("_i"))))
    drawn = (marked.join(F.broadcast(cut), by, "left")
             .where(F.col("_test") | F.coalesce(within, F.lit(False))).select(*marked.columns))
    # a group's examples are at most n_examples rows
    rank = F.row_number().over(Window.partitionBy(*by, "_test").orderBy("sample_key", "doc_id"))
    return drawn.withColumn("example_rank", F.when(~F.col("_test"), rank))


def balanced_few_shot_examples(corpus: DataFrame, test: DataFrame | int | None = None, n_examples: int = 3,
                               seed: int = 42, by: list[str] | None = None, strict: bool = True) -> DataFrame:
    """``max(1, n_examples // 2)`` rows per class outside the test set, ordered
    by key across classes.  A group where a class has fewer rows is an error;
    with ``strict`` off such a group gives the rows it has."""
    by = list(by or ["dataset"])
    k = max(1, n_examples // 2)
    if test is None:
        pool = with_key(labelled(corpus), seed)
    elif isinstance(test, int):
        pool = example_pool(corpus, test, seed, by)
    else:
        pool = with_key(labelled(exclude(corpus, test, by + ["doc_id"])), seed)
    if strict:
        found = _class_sizes(pool, by)
        groups = {tuple(r) for r in corpus.select(*by).distinct().collect()}
        short = sorted((str(g), lab, found.get(g, {}).get(lab, 0)) for g in groups for lab in (0, 1)
                       if found.get(g, {}).get(lab, 0) < k)
    if strict and short:
        raise ValueError(f"too few rows for {k} example(s) per class: " + ", ".join(
            f"{g} class {lab} has {n}" for g, lab, n in short))
    return rank_in_group(first_n_by_key(pool, by + ["label"], k), by, name="example_rank")


def class_counts(corpus: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = list(by or ["dataset"])
    return labelled(corpus).groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n_class"))


def _class_sizes(corpus: DataFrame, by: list[str]) -> dict:
    """{group: {label: rows}}, collected: one row per group and class."""
    sizes: dict = {}
    for r in class_counts(corpus, by).collect():
        sizes.setdefault(tuple(r[c] for c in by), {})[r["label"]] = r["n_class"]
    return sizes


def stratified_assignment(corpus: DataFrame, test_size: float = 0.2, seed: int = 42,
                          by: list[str] | None = None, salt: str | None = None,
                          test_name: str = "test", train_name: str = "train", sizes: dict | None = None) -> DataFrame:
    """Labelled rows with a ``split`` column: per class the first ``quota``
    rows in key order are ``test_name``, the rest ``train_name``.  Exact and
    fully distributed.  ``sizes``: the class sizes, where they are known."""
    by = list(by or ["dataset"])
    rows = labelled(corpus)
    sizes = _class_sizes(rows, by) if sizes is None else sizes
    quotas = {(*g, lab): q for g, cc in sizes.items() if sum(cc.values())
              for lab, q in _largest_remainder(cc, math.ceil(test_size * sum(cc.values()))).items()}
    marked = mark_first_n_by_key(with_key(rows, seed, salt), by + ["label"], quotas)
    return marked.withColumn("split", F.when(F.col("_selected"), test_name).otherwise(train_name)) \
        .drop("_selected", "sample_key")


def stratified_split(corpus: DataFrame, test_size: float = 0.2, seed: int = 42, by: list[str] | None = None,
                     salt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test) views of :func:`stratified_assignment`."""
    a = stratified_assignment(corpus, test_size, seed, by, salt)
    return a.where(F.col("split") == "train").drop("split"), a.where(F.col("split") == "test").drop("split")


def holdout_assignment(spark, corpus: DataFrame, sample_size: int | None, test_size: float = 0.2,
                       seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """Train/test ``split`` of the supervised baseline, decided per group:

    * ``sample_size`` smaller than the group: a balanced test sample when
      both classes have ``sample_size // 2`` rows, else a simple sample of
      ``sample_size`` rows; train is the rest;
    * otherwise a stratified ``test_size`` split.

    The decision reads one tiny aggregate (class counts per group, collected
    to the driver); the rows are then marked in one pass whose groups are
    (group, class) — or the group alone for a simple sample."""
    return _holdout(corpus, sample_size, test_size, seed, list(by or ["dataset"]))[0]


def _holdout(corpus: DataFrame, sample_size: int | None, test_size: float, seed: int,
             by: list[str]) -> tuple[DataFrame, dict | None]:
    """The assignment and, where the quotas settle them, the train rows' class sizes."""
    rows = labelled(corpus)
    quotas, train, simple = {}, {}, []
    for grp, cc in _class_sizes(rows, by).items():
        n = sum(cc.values())
        if sample_size and sample_size < n:
            half = sample_size // 2
            if cc.get(0, 0) >= half and cc.get(1, 0) >= half:
                own = {0: half, 1: half}
            else:
                quotas[(*grp, -1)] = sample_size
                simple.append(grp)
                continue
        else:
            own = _largest_remainder(cc, math.ceil(test_size * n))
        quotas.update({(*grp, lab): q for lab, q in own.items()})
        train[grp] = {lab: cc.get(lab, 0) - q for lab, q in own.items() if cc.get(lab, 0) > q}
    # groups drawing a simple sample rank all their rows together (_g = -1)
    in_simple = F.lit(False)
    for grp in simple:
        same = F.lit(True)
        for c, v in zip(by, grp):
            same = same & F.col(c).eqNullSafe(F.lit(v))
        in_simple = in_simple | same
    keyed = with_key(rows, seed).withColumn("_g", F.when(in_simple, F.lit(-1)).otherwise(F.col("label")).cast("int"))
    marked = mark_first_n_by_key(keyed, by + ["_g"], quotas)
    out = marked.withColumn("split", F.when(F.col("_selected"), "test").otherwise("train")) \
        .drop("_selected", "sample_key", "_g")
    return out, (None if simple else train)


def three_way_assignment(corpus: DataFrame, sample_size: int | None, test_size: float = 0.2, seed: int = 42,
                         by: list[str] | None = None) -> DataFrame:
    """``split`` of every labelled row: ``test`` by :func:`holdout_assignment`, and
    of the rest ``validation`` by a stratified carve-out, else ``train``."""
    by = list(by or ["dataset"])
    split, sizes = _holdout(corpus, sample_size, test_size, seed, by)
    rest = split.where("split = 'train'").drop("split")
    sizes = _class_sizes(rest, by) if sizes is None else sizes
    quotas = {(*g, lab): q for g, cc in sizes.items() if sum(cc.values())
              for lab, q in _largest_remainder(cc, math.ceil(test_size * sum(cc.values()))).items()}
    keyed = with_key(rest, seed, "validation")
    cut = cutoffs(keyed, by + ["label"], quotas).select(
        *by, "label", F.col("_cut_key").alias("_k"), F.col("_cut_id").alias("_i"), F.lit(True).alias("_listed"))
    k, i = sample_key(seed, salt="validation"), F.col("doc_id")
    within = F.col("_listed") & (F.col("_k").isNull() | (k < F.col("_k")) | ((k == F.col("_k")) & (i <= F.col("_i"))))
    # one pass over the marked rows: no union of the parts
    return (split.join(F.broadcast(cut), by + ["label"], "left")
            .withColumn("split", F.when((F.col("split") == "train") & F.coalesce(within, F.lit(False)), "validation")
                        .otherwise(F.col("split"))).select(*split.columns))


def _largest_remainder(class_counts: dict, n_draws: int) -> dict:
    """Integer per-class draws proportional to the class sizes summing to
    ``n_draws``: floors first, then the largest remainders (ties by label)."""
    total = sum(class_counts.values())
    cont = {k: v / total * n_draws for k, v in class_counts.items()}
    out = {k: math.floor(c) for k, c in cont.items()}
    left = n_draws - sum(out.values())
    for k in sorted(cont, key=lambda k: (-(cont[k] - out[k]), k))[:left]:
        out[k] += 1
    return out


def holdout_split(spark, corpus: DataFrame, sample_size: int | None, test_size: float = 0.2, seed: int = 42,
                  by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test) views of :func:`holdout_assignment`."""
    a = holdout_assignment(spark, corpus, sample_size, test_size, seed, by)
    return a.where(F.col("split") == "train").drop("split"), a.where(F.col("split") == "test").drop("split")
