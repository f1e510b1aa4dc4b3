"""Operator 1: quality rules with cross-document line frequency.

Normalised lines (lower case, digits as 0, white space as one gap) are hashed;
Spark counts for each host (``source``) and line the distinct documents that
hold it.  A line above the limit is boilerplate: it is removed from every
document of the host but the first (smallest ``doc_id``), so each line is kept
once; a line goes with the line feed that ends it.  A document left with too few of its words is depleted and rejected.
The limit is ``host_share`` of the host's documents, and at least the small floor
``min_documents``, alike at every table size.  Exact copies of a text count as one document, because copies are
not boilerplate.

Base figures of whole texts go along: words, their characters, symbols,
repeated lines, and words in repeated five-word windows.

Null text: no words (fails the base rules).  Null ``source``: a host of its
own.  Null ``doc_id``: base figures only; ``keep_documents`` keeps such rows.  Rows that share a
``doc_id`` count as one document of their host for each text, and each row is judged
by its own words and lines.  Empty tables give no rows.  Other columns are ignored
and kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import LOWER, U64, Words, documents, free_prefix, mix, pieces, span_hashes, text_bytes, written

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A line in more distinct texts of its host than this and than the share is boilerplate.
MIN_DOCUMENTS = 5
HOST_SHARE = 0.005
#: A document whose remaining words are under this share of its words is depleted.
MIN_LEFT_PERCENT = 30

NORMAL = LOWER.copy()
NORMAL[48:58] = 48
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def _lines(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines that hold a word: start and end byte, first word, end of words."""
    breaks = words.data == 10
    cuts = np.unique(np.concatenate([words.bounds[:-1], np.flatnonzero(breaks) + 1]))
    cuts = cuts[cuts < len(words.data)]
    ends = np.append(cuts[1:], len(words.data))
    first, last = np.searchsorted(words.starts, cuts), np.searchsorted(words.starts, ends)
    held = first < last
    cuts, ends, first, last = cuts[held], ends[held], first[held], last[held]
    ends = ends - (breaks[ends - 1] if len(ends) else 0)
    return cuts, ends, first, last


def _later_equals(document: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each hash: whether it was before in its document, and whether it is
    there more than once."""
    key = mix(hashes + mix(document.astype(U64) + U64(1)))
    _, first, entry, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return first[entry] != np.arange(len(key)), count[entry] > 1


def _per_document(words: Words, flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[first])


def _content(words: Words) -> np.ndarray:
    """Hash of each text's normalised words."""
    return span_hashes(words.hashes(NORMAL), words.first[:-1], words.first[1:])


def _base(batches):
    for whole in batches:
        for batch in pieces(whole):
            words = Words(*text_bytes(batch.column("text")))
            continued = (words.data & 0xC0) == 0x80
            starts, ends, _, _ = _lines(words)
            line_of = np.searchsorted(words.bounds, starts, side="right") - 1
            again, _ = _later_equals(line_of, span_hashes(words.data, starts, ends))
            at = words.windows(5)
            document = words.document()
            _, twice = _later_equals(document[at], span_hashes(words.hashes(), at, at + 5))
            depth = np.zeros(len(words.starts) + 1, np.int64)
            np.add.at(depth, at[twice], 1)
            np.add.at(depth, at[twice] + 5, -1)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "content": pa.array(_content(words).view(np.int64)),
                "n_words": pa.array(words.counts, pa.int64()),
                "word_chars": pa.array(_per_document(words, words.inside & ~continued, words.bounds), pa.int64()),
                "n_symbols": pa.array(_per_document(words, SYMBOL[words.data], words.bounds), pa.int64()),
                "n_dup_lines": pa.array(np.bincount(line_of, again, len(words.counts)).astype(np.int64)),
                "n_repeat_words": pa.array(_per_document(words, np.cumsum(depth)[:-1] > 0, words.first), pa.int64()),
            })


def base_figures(docs: DataFrame) -> DataFrame:
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _base, "doc_id long, content long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    return out.withColumn("base_failed", _failed(F.col("n_words"), F.col("n_repeat_words")))


def _failed(words: Column, repeated: Column) -> Column:
    return (words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * words)


def _host_key(batch) -> np.ndarray:
    data, bounds = text_bytes(batch.column("source"))
    null = np.asarray(batch.column("source").is_null(), dtype=bool)
    return mix(span_hashes(data, bounds[:-1], bounds[1:]) + null.astype(U64))


def _line_rows(batches):
    """A row for each distinct normalised line of a document."""
    for whole in batches:
        for batch in pieces(whole):
            words = Words(*text_bytes(batch.column("text")))
            starts, _, first, last = _lines(words)
            of = np.searchsorted(words.bounds, starts, side="right") - 1
            host = _host_key(batch)
            key = mix(span_hashes(words.hashes(NORMAL), first, last) + host[of])
            content = _content(words)
            _, at, entry = np.unique(mix(key + mix(of.astype(U64) + U64(1))), return_index=True, return_inverse=True)
            held = np.bincount(entry, last - first, len(at)).astype(np.int64)
            ids = batch.column("doc_id").take(pa.array(of[at]))
            yield pa.RecordBatch.from_pydict({
                "doc_id": ids, "host": pa.array(host[of[at]].view(np.int64)),
                "line": pa.array(key[at].view(np.int64)), "content": pa.array(content[of[at]].view(np.int64)),
                "words": pa.array(held)})


def document_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, host, line, content, words): hashed lines with their words."""
    return docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source")).mapInArrow(
        _line_rows, "doc_id long, host long, line long, content long, words long")


def frequent_lines(docs: DataFrame, lines: DataFrame, min_documents: int = MIN_DOCUMENTS,
                   host_share: float = HOST_SHARE) -> DataFrame:
    """(line, first): lines above their host's limit and the document that keeps it.
    Two partial aggregations, so a line of a third of all documents is counted
    where it is read; only lines above ``min_documents`` meet the host's size."""
    counts = (lines.groupBy("host", "line", "content").agg(F.min("doc_id").alias("first"))
              .groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"))
              .where(F.col("n") > min_documents))
    size = lines.groupBy("host", "content").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("one").alias("size"))
    return counts.join(size, "host").where(F.col("n") > host_share * F.col("size")).select("line", "first")


def removed_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, host_share: float = HOST_SHARE) -> DataFrame:
    """(doc_id, content, lines, n_removed_words): what each text of a document loses."""
    lines = written(document_lines(docs), "document-lines")
    frequent = frequent_lines(docs, lines, min_documents, host_share)
    return (lines.join(frequent, "line").where(F.col("doc_id") != F.col("first"))
            .groupBy("doc_id", "content", "line").agg(F.max("words").alias("words"))
            .groupBy("doc_id", "content").agg(F.collect_list("line").alias("lines"), F.sum("words").alias("n_removed_words")))


def _without(lines_column: str):
    """Texts without the lines named in a column."""
    def without(batches):
        for whole in batches:
            for batch in pieces(whole):
                gone = batch.column(lines_column).to_pylist()
                yield _cut(batch, gone) if any(gone) else batch
    return without


def _cut(batch: pa.RecordBatch, gone: list) -> pa.RecordBatch:
    words = Words(*text_bytes(batch.column("text")))
    starts, ends, first, last = _lines(words)
    of = np.searchsorted(words.bounds, starts, side="right") - 1
    line = mix(span_hashes(words.hashes(NORMAL), first, last) + _host_key(batch)[of]).view(np.int64)
    edges = np.searchsorted(of, np.arange(len(gone) + 1))
    texts = batch.column("text").to_pylist()
    for i, lines in enumerate(gone):
        if lines:
            mine = slice(edges[i], edges[i + 1])
            hit = np.isin(line[mine], np.array(lines, np.int64))
            cuts = zip(starts[mine][hit] - words.bounds[i], ends[mine][hit] - words.bounds[i])
            raw, at, left = texts[i].encode(), 0, []
            for begin, end in cuts:
                left.append(raw[at:begin])
                at = min(end + 1, len(raw))
            texts[i] = b"".join([*left, raw[at:]]).decode()
    return batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))


def _judged(figures: DataFrame, removed: DataFrame, p: str = "") -> DataFrame:
    """Figures (columns behind the prefix ``p``) with what is removed and the verdict."""
    key = (F.col(f"{p}doc_id") == F.col(f"{p}gone_doc_id")) & (F.col(f"{p}content") == F.col(f"{p}gone_content"))
    gone = removed.select(F.col("doc_id").alias(f"{p}gone_doc_id"), F.col("content").alias(f"{p}gone_content"),
                          F.col("lines").alias(f"{p}lines"), F.col("n_removed_words").alias(f"{p}n_removed_words"))
    out = figures.join(gone, key, "left").drop(f"{p}gone_doc_id", f"{p}gone_content")
    out = out.withColumn(f"{p}n_removed_words", F.coalesce(f"{p}n_removed_words", F.lit(0).cast("long")))
    words = F.col(f"{p}n_words")
    depleted = 100 * (words - F.col(f"{p}n_removed_words")) < MIN_LEFT_PERCENT * words
    return out.withColumn(f"{p}kept", ~F.col(f"{p}base_failed") & ~depleted)


def judge(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, host_share: float = HOST_SHARE) -> DataFrame:
    """A row for each document: base figures, ``n_removed_words`` (of lines above
    the limit) and ``kept``."""
    return _judged(base_figures(docs), removed_lines(docs, min_documents, host_share)).drop("lines", "content")


def keep_documents(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, host_share: float = HOST_SHARE) -> DataFrame:
    """The documents that ``judge`` keeps, without the removed lines.  Columns are
    those of ``docs``; ``n_chars``, if there, follows the text."""
    columns, p = docs.columns, free_prefix(docs.columns)

    def flag(batches):
        for whole in batches:
            for batch in pieces(whole):
                figures = next(_base(iter([batch.select(["text", f"{p}doc_id"]).rename_columns(["text", "doc_id"])])))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, figures.column("content"), figures.column("n_words"), figures.column("n_repeat_words")],
                    [*batch.schema.names, f"{p}content", f"{p}n_words", f"{p}n_repeat_words"])
    named = docs.withColumn(f"{p}doc_id", F.col("doc_id").cast("long"))
    schema = StructType([*named.schema.fields, *(StructField(f"{p}{c}", LongType()) for c in ("content", "n_words", "n_repeat_words"))])
    flagged = named.mapInArrow(flag, schema)
    flagged = flagged.withColumn(f"{p}base_failed", _failed(F.col(f"{p}n_words"), F.col(f"{p}n_repeat_words")))
    judged = _judged(flagged, removed_lines(docs, min_documents, host_share), p)
    kept = judged.where(F.col(f"{p}kept") | F.col("doc_id").isNull()).select(*columns, f"{p}lines")
    out = kept.mapInArrow(_without(f"{p}lines"), kept.schema)
    if "n_chars" in columns:
        size = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(f"{p}lines").isNull(), F.col("n_chars")).otherwise(size))
    return out.select(columns)


def op1_line_frequency(spark, sf_dir):
    return judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_removed_words")
