"""Corpus sources: registry-driven reads, column standardisation, label maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import LOCAL_FORMATS, dataset_config
from ..functions.names import free_name


def read_source(spark: SparkSession, path: str, fmt: str, schema: StructType | str | None = None,
                multi_line_json: bool = False, multi_line_csv: bool = True) -> DataFrame:
    """One scan of a landed file or folder.

    * csv: header row, quoted fields may hold newlines (``multiLine`` +
      ``escape='"'``, one task per file); ``multi_line_csv=False`` states that
      they do not, and the file is split.  Give a schema at scale instead of
      inferring one.
    * json: JSON-lines by default (splittable); ``multi_line_json`` for
      whole-file arrays.
    * parquet: columnar, filters and projections reach the scan.
    """
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", True).option("multiLine", multi_line_csv).option("escape", '"')
        if schema is None:
            r = r.option("inferSchema", True)
        return r.csv(path)
    if fmt == "json":
        return r.option("multiLine", multi_line_json).json(path)
    if fmt == "parquet":
        return r.parquet(path)
    raise ValueError(f"Unsupported format: {fmt}")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def load_local_dataset(spark: SparkSession, name: str, data_dir: str, schema=None,
                       multi_line_json: bool = True, multi_line_csv: bool = True) -> DataFrame:
    """First of ``{name}.csv``, ``{name}.json``, ``{name}.parquet`` that exists
    (checked on the cluster file system), read with :func:`read_source`.  The
    ``multi_line`` options off read line-delimited JSON and plain CSV in splits."""
    for fmt in LOCAL_FORMATS:
        path = f"{data_dir.rstrip('/')}/{name}.{fmt}"
        if _exists(spark, path):
            return read_source(spark, path, fmt, schema=schema, multi_line_json=multi_line_json,
                               multi_line_csv=multi_line_csv)
    raise FileNotFoundError(f"Dataset '{name}' not found in {data_dir}; land the file there first.")


def standardize_columns(df: DataFrame, config: dict) -> DataFrame:
    """Rename the configured text and label columns to ``text`` and ``label``;
    columns that are absent are ignored, other columns pass through."""
    ren = {}
    for src, dst in ((config.get("text_column"), "text"), (config.get("label_column"), "label")):
        if src and src != dst and src in df.columns:
            ren[src] = dst
    return df.withColumnsRenamed(ren) if ren else df


def mapped_label(raw, mapping: dict | None) -> Column:
    """Apply a label map (raw value as text -> class).  Raw values that are
    already a class (``0``/``1``) pass through when the map has no numeric
    keys; anything else becomes NULL and is left out of samples."""
    r = (F.col(raw) if isinstance(raw, str) else raw).cast("string")
    passthrough = F.when(r.isin("0", "1"), r.cast("int"))
    if not mapping:
        return passthrough
    keys = [str(k) for k in mapping]
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(str(k)), F.lit(int(v)))])
    mapped = F.when(r.isin(*keys), m[r])
    if any(k in ("0", "1") for k in keys):
        return mapped.cast("int")
    return F.coalesce(mapped, passthrough).cast("int")


def apply_label_mapping(df: DataFrame, mapping: dict | None, keep_raw: bool = True) -> DataFrame:
    out = df.withColumn("label_raw", F.col("label")) if keep_raw else df
    return out.withColumn("label", mapped_label("label", mapping))


#: Copies of one row that a task numbers.
COPIES_A_TASK = 100_000


def content_ids(df: DataFrame, name: str = "doc_id", copies_a_task: int = COPIES_A_TASK) -> DataFrame:
    """Ids from the rows' content, the same however the files are split: a 64-bit
    hash of all columns, and of the copy's number among equal rows.

    Equal rows are interchangeable, so they are counted (a partial aggregate: a row
    that is a third of the corpus sends one row a task) and written out again,
    numbered from one; more than ``copies_a_task`` of them are dealt to several
    tasks.  Costs a shuffle of the distinct rows; name an ``id_column`` for large
    corpora."""
    h1, h2, n, part = (free_name([*df.columns, name], x) for x in ("h1", "h2", "n", "part"))
    shown = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in sorted(df.columns)]
    keyed = df.select("*", F.xxhash64(*shown).alias(h1), F.hash(F.lit(7), *shown).alias(h2))
    every = [F.col(f"`{c}`") for c in df.columns]
    if any(_has_map(f.dataType) for f in df.schema.fields):  # no grouping by maps
        row = free_name([*df.columns, h1, h2], "row")
        counted = keyed.groupBy(h1, h2).agg(F.first(F.struct(*every)).alias(row), F.count(F.lit(1)).alias(n)) \
            .select(f"{row}.*", h1, h2, n)
    else:
        counted = keyed.groupBy(*every, h1, h2).agg(F.count(F.lit(1)).alias(n))

    def numbered(rows: DataFrame, first: Column, last: Column) -> DataFrame:
        copy = free_name([*df.columns, name], "copy")
        out = rows.select(*every, h1, h2, F.explode(F.sequence(first, last)).alias(copy))
        return out.select(*every, F.xxhash64(h1, h2, F.col(copy).cast("int")).alias(name))
    few = numbered(counted.where(F.col(n) <= copies_a_task), F.lit(1).cast("long"), F.col(n))
    parts = counted.where(F.col(n) > copies_a_task).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / copies_a_task))).alias(part))
    # a number of its own: adaptive execution would see small rows and put them together
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts.repartition(tasks, F.col(h1), F.col(h2), F.col(part))
    start = F.col(part) * copies_a_task
    return few.unionByName(numbered(parts, start + 1, F.least(F.col(n), start + copies_a_task)))


def _has_map(kind) -> bool:
    return "map<" in kind.simpleString()


def read_dataset(spark: SparkSession, name: str, data_dir: str, registry: dict | None = None,
                 schema=None, **read_options) -> DataFrame:
    """Registry lookup -> landed file -> standard columns -> mapped labels.

    Adds ``dataset`` and, when the source has no id column configured, a
    ``doc_id`` from the row's content (:func:`content_ids`): samples are the
    same on every cluster and read."""
    cfg = dataset_config(name, registry)
    df = load_local_dataset(spark, name, data_dir, schema=schema, **read_options)
    id_col = cfg.get("id_column")
    if id_col and id_col in df.columns:
        df = df.withColumnRenamed(id_col, "doc_id") if id_col != "doc_id" else df
    elif "doc_id" not in df.columns:
        df = content_ids(df)
    df = apply_label_mapping(standardize_columns(df, cfg), cfg.get("label_mapping"))
    return df.withColumn("dataset", F.lit(name))


def unmapped_labels(corpus: DataFrame) -> DataFrame:
    """(dataset, label_raw, n): raw label values that the map does not cover, with
    their rows.  These rows are in no sample; this is their report."""
    return (corpus.where(F.col("label").isNull()).groupBy("dataset", F.col("label_raw").cast("string").alias("label_raw"))
            .agg(F.count(F.lit(1)).alias("n")))


def corpus_from_tables(documents: DataFrame, labels: DataFrame, name: str, config: dict) -> DataFrame:
    """A labelled corpus assembled from a text table and a label table that
    share ``doc_id``: ``dataset, doc_id, text, label``.

    Only the two needed columns of each side are read; the join is an
    ordinary equi-join (AQE turns it into a broadcast when one side is
    small at run time, a sort-merge join otherwise)."""
    docs = documents.select("doc_id", F.col(config.get("text_column", "text")).alias("text"))
    labs = labels.select("doc_id", F.col(config["label_column"]).alias("label"))
    df = docs.join(labs, "doc_id")
    return df.select(F.lit(name).alias("dataset"), "doc_id", "text",
                     mapped_label("label", config.get("label_mapping")).alias("label"))


def corpora_from_tables(documents: DataFrame, labels: DataFrame, configs: dict) -> DataFrame:
    """Several labelled corpora that share one text table and one label
    table, in a single join: every label row is first expanded to one row
    per dataset (``dataset, doc_id, label``), then joined once to the texts.
    The text table is scanned and shuffled once, whatever the number of
    datasets."""
    text_cols = {cfg.get("text_column", "text") for cfg in configs.values()}
    if len(text_cols) != 1:
        return union_corpora([corpus_from_tables(documents, labels, n, c) for n, c in configs.items()])
    per_ds = F.explode(F.array(*[
        F.struct(F.lit(name).alias("dataset"), mapped_label(cfg["label_column"], cfg.get("label_mapping")).alias("label"))
        for name, cfg in configs.items()])).alias("_d")
    labs = labels.select("doc_id", per_ds).select("doc_id", "_d.dataset", "_d.label")
    docs = documents.select("doc_id", F.col(text_cols.pop()).alias("text"))
    return labs.join(docs, "doc_id").select("dataset", "doc_id", "text", "label")


def corpus_keys_from_tables(documents: DataFrame, labels: DataFrame, configs: dict) -> DataFrame:
    """``dataset, doc_id, label`` of several corpora without their texts:
    label rows (one per dataset) that have a document.  Only the ``doc_id``
    column of the text table is read.  Samples are drawn from this and the
    texts attached afterwards (:func:`attach_text`), so a huge text table is
    never shuffled to pick a few thousand rows."""
    per_ds = F.explode(F.array(*[
        F.struct(F.lit(name).alias("dataset"), mapped_label(cfg["label_column"], cfg.get("label_mapping")).alias("label"))
        for name, cfg in configs.items()])).alias("_d")
    labs = labels.select("doc_id", per_ds).select("doc_id", "_d.dataset", "_d.label")
    return labs.join(documents.select("doc_id"), "doc_id", "left_semi").select("dataset", "doc_id", "label")


#: Most rows that are broadcast to attach texts to them.
MOST_BROADCAST = 1_000_000


def attach_text(rows: DataFrame, documents: DataFrame, text_column: str = "text", at_most: int | None = None) -> DataFrame:
    """Texts for drawn rows (a sample, few-shot examples).  With ``at_most``, the
    caller's bound on their number, up to ``MOST_BROADCAST`` they are broadcast
    and the text table is only streamed past them; otherwise the planner chooses
    the join.  The result is the same."""
    docs = documents.select("doc_id", F.col(text_column).alias("text"))
    few = at_most is not None and at_most <= MOST_BROADCAST
    return docs.join(F.broadcast(rows) if few else rows, "doc_id").select(*rows.columns, "text")


def union_corpora(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
