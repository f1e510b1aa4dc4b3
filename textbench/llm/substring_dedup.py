"""Operator 10: substring deduplication over fixed-length token windows.

Rabin-Karp hashes of every window of ``window`` words are counted in Spark: the
first document of each window hash stays, and in every other document the
repeated windows merge into maximal removal intervals.

Documents are dealt into blocks by a hash of ``doc_id``.  A block sends each
distinct window hash once, with the smallest ``doc_id`` that has it, so a window
that a third of all documents share costs one entry per block and not one per
document.  Entries travel as byte planes of sorted hashes, a row for each block
and hash range; the answer is one bit per entry.  Nothing is capped: a block's
memory is set by ``block_bytes``.

Windows are compared by 64-bit hashes: with n distinct windows in the corpus a
window is taken for another one with probability n / 2**64.

Null text: no words.  Null ``doc_id``: the row is returned whole and compared
with nothing.  Rows that share a ``doc_id`` never remove words from each other.
Texts with fewer words than a window stay whole.  An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, asking_blocks, block_of, dealt_by, documents, ragged, span_hashes, text_bytes, text_size

WINDOW = 50
BLOCK_BYTES = 4 << 20


def planes(values: np.ndarray) -> bytes:
    """Eight-byte values by byte plane; the shuffle's compression then removes
    the planes that hardly vary."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(blob: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(kind).ravel()


class _Block:
    """Windows of one block, its documents in ``doc_id`` order."""

    def __init__(self, table: pa.Table, window: int):
        table = table.filter(pc.is_valid(table["doc_id"])).sort_by("doc_id")
        self.ids = table["doc_id"].to_numpy().astype(np.int64)
        self.words = Words(*text_bytes(table["text"]))
        at = self.words.windows(window)
        self.at, self.of = at, self.words.document()[at]
        hashes = span_hashes(self.words.hashes(), at, at + window)
        self.hashes, first, self.entry = np.unique(hashes, return_index=True, return_inverse=True)
        self.least = self.ids[self.of[first]]

    def ranges(self, buckets: int) -> np.ndarray:
        """Where each of the equal hash ranges ends in the sorted hashes."""
        bucket = ((self.hashes >> U64(32)) * U64(buckets)) >> U64(32)
        return np.searchsorted(bucket, np.arange(buckets + 1, dtype=U64))


def _send(window: int, buckets: int):
    def send(table: pa.Table) -> pa.Table:
        block = _Block(table, window)
        cut = block.ranges(buckets)
        sent = [b for b in range(buckets) if cut[b] < cut[b + 1]]
        return pa.table({
            "bucket": pa.array(sent, pa.int32()),
            "block": pa.array([table["block"][0].as_py()] * len(sent), pa.int32()),
            "hashes": pa.array([planes(np.diff(block.hashes[cut[b]:cut[b + 1]], prepend=U64(0))) for b in sent],
                               pa.binary()),
            "least": pa.array([planes(block.least[cut[b]:cut[b + 1]]) for b in sent], pa.binary()),
        })
    return send


def _answer(table: pa.Table) -> pa.Table:
    """For one hash range: which entries are not the first document's."""
    hashes = [np.cumsum(from_planes(x.as_py(), U64), dtype=U64) for x in table["hashes"]]
    least = [from_planes(x.as_py(), np.int64) for x in table["least"]]
    size = np.cumsum([0] + [len(x) for x in hashes])
    _, entry = np.unique(np.concatenate(hashes), return_inverse=True)
    ids = np.concatenate(least)
    first = np.full(entry.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, entry, ids)
    later = ids > first[entry]
    return pa.table({
        "block": table["block"], "bucket": table["bucket"],
        "later": pa.array([np.packbits(later[a:b]).tobytes() for a, b in zip(size, size[1:])], pa.binary()),
    })


def _kept_text(words: Words, removed: np.ndarray) -> pa.Array:
    """Kept words of each document joined by one space."""
    data, keep = words.data.copy(), np.zeros(len(words.data) + 1, np.int64)
    kept = np.flatnonzero(~removed)
    np.add.at(keep, words.starts[kept], 1)
    np.add.at(keep, words.ends[kept], -1)
    keep = np.cumsum(keep)[:-1] > 0
    document = words.document()[kept]
    joined = words.ends[kept[:-1][document[:-1] == document[1:]]] if len(kept) else kept
    data[joined] = 0x20
    keep[joined] = True
    ends = np.concatenate([[0], np.cumsum(keep)])[words.bounds]
    return pa.LargeStringArray.from_buffers(len(words.counts), pa.py_buffer(ends.astype(np.int64)),
                                            pa.py_buffer(data[keep]))


def _apply(window: int, buckets: int):
    def apply(table: pa.Table, answers: pa.Table) -> pa.Table:
        valid = pc.is_valid(table["doc_id"])
        block = _Block(table, window)
        words, n = block.words, len(block.words.starts)
        later = np.zeros(len(block.hashes), bool)
        cut = block.ranges(buckets)
        for bucket, bits in zip(answers["bucket"].to_pylist(), answers["later"].to_pylist()):
            a, b = cut[bucket], cut[bucket + 1]
            later[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        repeated = later[block.entry] | (block.ids[block.of] > block.least[block.entry])
        depth = np.zeros(n + 1, np.int64)
        depth[block.at[repeated]] += 1
        np.add.at(depth, block.at[repeated] + window, -1)
        removed = np.cumsum(depth)[:-1] > 0
        out = [_rows(table.filter(valid).sort_by("doc_id")["doc_id"], words, removed)]
        if not pc.all(valid).as_py():
            rest = table.filter(pc.invert(valid))
            words = Words(*text_bytes(rest["text"]))
            out.append(_rows(rest["doc_id"], words, np.zeros(len(words.starts), bool)))
        return pa.concat_tables(out)
    return apply


def _rows(ids: pa.ChunkedArray, words: Words, removed: np.ndarray) -> pa.Table:
    document = words.document()
    edge = np.diff(np.concatenate([[False], removed, [False]]).astype(np.int8))
    # an interval also ends where its document ends
    inner = words.first[1:-1]
    inner = inner[(inner > 0) & (inner < len(removed))]
    inner = np.unique(inner[removed[inner - 1] & removed[inner]]) if len(inner) else inner
    begins = np.sort(np.concatenate([np.flatnonzero(edge == 1), inner]))
    ends = np.sort(np.concatenate([np.flatnonzero(edge == -1), inner]))
    of = document[begins] if len(begins) else begins
    offsets = np.searchsorted(of, np.arange(len(words.counts) + 1))
    base = words.first[of] if len(of) else of
    total = np.concatenate([[0], np.cumsum(removed)])
    return pa.table({
        "doc_id": ids.combine_chunks().cast(pa.int64()) if ids.num_chunks != 1 else ids.chunk(0).cast(pa.int64()),
        "n_words": pa.array(words.counts, pa.int64()),
        "n_removed": pa.array(np.diff(total[words.first]), pa.int64()),
        "starts": ragged(offsets, (begins - base).astype(np.int64), pa.int64()),
        "ends": ragged(offsets, (ends - base).astype(np.int64), pa.int64()),
        "kept_text": _kept_text(words, removed).cast(pa.string()),
    })


def remove_repeated(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document: ``n_words``, ``n_removed``, the removal intervals
    (word positions ``starts`` and ``ends``) and the kept words as ``kept_text``.
    ``doc_id`` must be integer."""
    blocks = asking_blocks(text_size(docs), block_bytes)
    # rows without an id ask for nothing and go to many blocks
    block = F.when(F.col("doc_id").isNull(), block_of(blocks, "text")).otherwise(block_of(blocks, F.col("doc_id").cast("long")))
    dealt = dealt_by(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", block.alias("block")),
                     "block", blocks)
    sent = dealt.groupBy("block").applyInArrow(_send(window, blocks),
                                               "bucket int, block int, hashes binary, least binary")
    answers = dealt_by(sent, "bucket", blocks).groupBy("bucket").applyInArrow(
        _answer, "block int, bucket int, later binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _apply(window, blocks),
        "doc_id long, n_words long, n_removed long, starts array<long>, ends array<long>, kept_text string")


def op10_substring_dedup(spark, sf_dir):
    out = remove_repeated(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
