"""Operator 5: token files with frequency-ranked ids in byte-aligned codes.

Ids are replaced by their rank in the corpus (0 for the most frequent) and coded
in one to four bytes; two bits of a separate control byte give each code's
length, four codes to a control byte.  Frequent tokens thus take one byte, and a
segment is decoded by numpy table lookups without a loop over its codes.

Files are Parquet tables in a folder that executors share: ``tokens`` has
segments of whole documents in ascending ``doc_id`` order (shard, segment,
document ids, token counts, control bytes, data bytes), ``ranks`` the id of
each rank.

A text is tokenized by its distinct words, each of them once in a task, and not
again in the job's next tasks of that Python worker while it is kept: the tokenizer lowers case, drops white space and never looks across it, nor across
the border of a letter or digit and punctuation after it, so the ids are those of
the whole text.  Words of letters only are encoded many at a time, where the
tokens that end a word tell them apart; those of Latin letters skip the tokenizer's
normaliser and its pattern, which give them back in lower case and whole, and those
of ASCII letters its spelling of bytes, which leaves them as they are.  Words are
remembered in lower case, except those with ``<``: the tokenizer's special tokens
are recognised in texts as they are spelled, as the library does by default.

Null or empty text: the end id alone.  Null ``doc_id``: before all others.
Rows that share a ``doc_id`` are written one after the other.  An empty table
writes no segments and gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import (LOWER, Words, block_count, documents, give_back, pieces, ragged, shared_path, span_hashes,
                     text_bytes, text_size)

SEGMENT_BYTES = 2 << 20
SHARD_BYTES = 16 << 20
END_ID = 2
#: Most segments whose starts are broadcast when files are read (about 40 bytes each).
MOST_BROADCAST = 1_000_000

#: Code lengths of the four codes that a control byte describes.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1).astype(np.uint8)

#: Words that a Python worker keeps from one task to the next, at most.
MOST_KEPT = 500_000


def _kept(path: str) -> dict:
    """What a process has made of the tokenizer's file, until the file changes.  It is
    kept with the library: this module travels by value and is a new one in each task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
    import tokenizers
    file = os.stat(path)
    every = vars(tokenizers).setdefault("_textbench", {})
    state, kept = every.get(path, (None, {}))
    if state != (file.st_mtime_ns, file.st_size):
        every[path] = (file.st_mtime_ns, file.st_size), (kept := {})
    return kept


def _words_of(path: str, job: str) -> dict:
    """The words that a process keeps for a job's next tasks; those of another job go."""
    kept = _kept(path)
    if kept.get("job") != job:
        kept |= {"job": job, "held": {}}
    return kept["held"]


def _tokenizer(path: str):
    kept = _kept(path)
    if "whole" not in kept:
        from tokenizers import Tokenizer
        kept["whole"] = Tokenizer.from_file(path)
    return kept["whole"]


#: Letters whose lower case is one letter, the same in all Unicode versions.
_LATIN = "^[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F]+$"


def _words_only(path: str):
    """The tokenizer for words of Latin letters in lower case, divided by blanks, and
    that for words of ASCII letters alone, whose bytes stand for themselves: the same
    model behind a plain split.  None if the tokenizer does more to such words than to
    lower them and take them whole."""
    kept = _kept(path)
    if "words" not in kept:
        from tokenizers import Tokenizer, pre_tokenizers
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        steps = [n.get("type") for n in (rules["normalizer"] or {}).get("normalizers", [])]
        before = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
        known = steps == ["NFC", "Replace", "Lowercase"] and [b.get("type") for b in before] == ["Split", "ByteLevel"] \
            and "[\\p{L}]+" in before[0]["pattern"].get("Regex", "") and not before[1].get("add_prefix_space")
        if known:
            latin, ascii_only = (Tokenizer(_tokenizer(path).model) for _ in range(2))
            split = pre_tokenizers.CharDelimiterSplit(" ")
            latin.pre_tokenizer = pre_tokenizers.Sequence(
                [split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            ascii_only.pre_tokenizer = split
        kept["words"] = (latin, ascii_only) if known else None
    return kept["words"]


_TAIL = np.zeros(256, bool)
_TAIL[list(b".,;:!?")] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[list(range(48, 58)) + list(range(97, 123))] = True
#: Punctuation that is in no special token, so that one never reaches across a cut before it.
_ANY_TAIL = np.zeros(256, bool)
_ANY_TAIL[list(b"!\"#$%&'()*+,-./:;=?@[\\]^_`{}~")] = True
#: Letters of two bytes, by code point less 0xC0: those of _LATIN.
_TWO_BYTES = np.ones(0xC0, bool)
_TWO_BYTES[[0xD7 - 0xC0, 0xF7 - 0xC0, 0x130 - 0xC0]] = False


def _after_plain(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether an ASCII letter, in lower case, or digit ends there."""
    return _PLAIN[data[ends - 1]]


def _after_letter(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether such a letter or digit, or a Latin letter of two bytes, ends there."""
    found = _after_plain(data, ends)
    wide = np.flatnonzero(data[ends - 1] >= 0x80)
    lead, last = data[ends[wide] - 2], data[ends[wide] - 1]
    two = (lead >= 0xC3) & (lead <= 0xC5)
    found[wide[two]] = _TWO_BYTES[(lead[two].astype(np.int64) - 0xC3) * 64 + (last[two] - 0x80)]
    return found


def _units(words: Words, data: np.ndarray, tail: np.ndarray = _TAIL,
           after=_after_plain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans to encode, words without punctuation at their end and that
    punctuation, and each word's first unit.  ``tail``: that punctuation; ``after``:
    whether there is a cut where what is left of a word ends."""
    starts, ends = words.starts, words.ends.copy()
    going = np.arange(len(ends))
    for _ in range(4):  # most words have no punctuation: only those that had some are looked at again
        going = going[tail[data[ends[going] - 1]] & (ends[going] - starts[going] > 1)]
        ends[going] -= 1
    cut = ends < words.ends
    cut[cut] = after(data, ends[cut])
    ends = np.where(cut, ends, words.ends)
    first = np.arange(len(starts)) + np.cumsum(cut) - cut
    unit_starts, unit_ends = (np.empty(len(starts) + int(cut.sum()), np.int64) for _ in range(2))
    unit_starts[first], unit_ends[first] = starts, ends
    unit_starts[first[cut] + 1], unit_ends[first[cut] + 1] = ends[cut], words.ends[cut]
    return unit_starts, unit_ends, np.append(first, len(unit_starts))


class WordIds:
    """Ids of words, remembered (forgotten beyond ``most``).  ``held``: where."""

    def __init__(self, path: str, most: int = MOST_KEPT, held: dict | None = None):
        self.tokenizer, self.most, self.words_only = _tokenizer(path), most, _words_only(path)
        kept = _kept(path)
        if "ends" not in kept:
            vocabulary = self.tokenizer.get_vocab()
            kept["ends"] = ends = np.zeros(max(vocabulary.values()) + 1, bool)
            ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.ends, self.held = kept["ends"], {} if held is None else held
        if "known" in self.held:
            self.hashes, self.place, self.bounds, self.ids = self.held["known"]
        else:
            self._forget()

    def _forget(self):
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.bounds, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _encode(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of new words."""
        latin = np.asarray(pc.match_substring_regex(strings, _LATIN), bool)
        if self.words_only is None:
            latin[:] = False
        ascii_only = latin & np.asarray(pc.string_is_ascii(strings), bool)
        others = np.flatnonzero(~latin)
        alone = np.array([t.isalpha() and t.lower().isalpha() for t in strings.take(pa.array(others)).to_pylist()], bool)
        order, sizes, ids, rest = [], [], [], [others[~alone]]
        for tokenizer, joined in zip((*(self.words_only or (None, None)), self.tokenizer),
                                     (np.flatnonzero(latin & ~ascii_only), np.flatnonzero(ascii_only), others[alone])):
            if not len(joined):
                continue
            edges = np.append(np.arange(0, len(joined), 250), len(joined))
            lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), strings.take(pa.array(joined))),
                                   pa.scalar(" ", pa.large_string())).to_pylist()
            if tokenizer is not self.tokenizer:
                lines = [line.lower() for line in lines]
            coded = tokenizer.encode_batch_fast(lines, add_special_tokens=False)
            for part, c in zip(np.split(joined, edges[1:-1]), coded):
                own = np.array(c.ids, np.uint32)
                last = np.flatnonzero(self.ends[own])
                if len(last) == len(part):
                    order.append(part)
                    sizes.append(np.diff(last, prepend=-1))
                    ids.append(own)
                else:  # a word that the tokenizer splits after all
                    rest.append(part)
        rest = np.concatenate(rest)
        for begin in range(0, len(rest), 2000):
            part = rest[begin:begin + 2000]
            lists = [c.ids for c in self.tokenizer.encode_batch_fast(strings.take(pa.array(part)).to_pylist(),
                                                                     add_special_tokens=False)]
            order.append(part)
            sizes.append(np.array([len(x) for x in lists], np.int64))
            ids.append(np.array([i for x in lists for i in x], np.uint32))
        order, sizes, ids = (np.concatenate(x) for x in (order, sizes, ids))
        begins, back = np.cumsum(sizes) - sizes, np.argsort(order)
        sizes, begins = sizes[back], begins[back]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return sizes, ids[np.repeat(begins - ends[:-1], sizes) + np.arange(ends[-1])]

    def look_up(self, hashes: np.ndarray, texts_of) -> np.ndarray:
        """Places in ``bounds`` of distinct hashes; ``texts_of(rows)`` gives the texts of some."""
        if len(self.hashes) > self.most:
            self._forget()
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        new = np.flatnonzero(~known)
        found = np.zeros(len(hashes), np.int64)
        found[known] = self.place[at[known]]
        if len(new):
            sizes, ids = self._encode(texts_of(new))
            found[new] = added = np.arange(len(new)) + len(self.bounds) - 1
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, ids])
            merged, place = np.concatenate([self.hashes, hashes[new]]), np.concatenate([self.place, added])
            order = np.argsort(merged, kind="stable")
            self.hashes, self.place = merged[order], place[order]
            self.held["known"] = self.hashes, self.place, self.bounds, self.ids
        return found


def tokenize(texts: pa.Array, known: WordIds, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each closed by ``end_id``, and each text's bounds."""
    words = Words(*text_bytes(texts))
    data = LOWER[words.data]
    starts, ends, first_unit = _units(words, data, _ANY_TAIL, _after_letter)
    marked = words.data == ord("<")
    if marked.any():  # a special token may be there: as it is spelled
        count = np.concatenate([[0], np.cumsum(marked)])
        spelled = np.flatnonzero(count[ends] > count[starts])
        edge = np.zeros(len(data) + 1, np.int64)
        edge[starts[spelled]] += 1
        np.add.at(edge, ends[spelled], -1)
        as_is = np.cumsum(edge)[:-1] > 0
        data[as_is] = words.data[as_is]
    entry, hashes = pd.factorize(span_hashes(data, starts, ends))
    first = np.empty(len(hashes), np.int64)
    first[entry[::-1]] = np.arange(len(entry))[::-1]

    def texts_of(rows: np.ndarray) -> pa.Array:
        begin, size = starts[first[rows]], (ends - starts)[first[rows]]
        bounds = np.concatenate([[0], np.cumsum(size)])
        raw = words.data[np.repeat(begin - bounds[:-1], size) + np.arange(bounds[-1])]
        return pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw))
    place = known.look_up(hashes, texts_of)[entry]
    size = known.bounds[place + 1] - known.bounds[place]
    unit_ends = np.concatenate([[0], np.cumsum(size)])
    plain = known.ids[np.repeat(known.bounds[place] - unit_ends[:-1], size) + np.arange(unit_ends[-1])]
    bounds = unit_ends[first_unit[words.first]]
    # one place more for each document's end
    ids = np.insert(plain, bounds[1:], np.uint32(end_id))
    return ids, bounds + np.arange(len(bounds))


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of 32-bit values."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    padded[:len(code)] = code
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    used = np.arange(4, dtype=np.uint8) <= code[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_ranks(control: bytes, data: bytes, count: int) -> np.ndarray:
    """Values from control and data bytes: lengths by table, bytes by offset."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    at = np.cumsum(size, dtype=np.int64) - size
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    out = raw[at].astype(np.uint32)
    for i in range(1, int(size.max(initial=1))):  # most codes have one byte or two
        more = np.flatnonzero(size > i)
        out[more] |= raw[at[more] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids): each text's ids as little-endian unsigned 32-bit integers,
    stored by byte plane."""
    job = uuid.uuid4().hex

    def run(batches):
        known = WordIds(path, held=_words_of(path, job))
        for whole in batches:
            for batch in pieces(whole, most=SEGMENT_BYTES):
                ids, bounds = tokenize(batch.column("text"), known, end_id)
                raw = _planes_of(ids, bounds)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())],
                                                 ["doc_id", "ids"])
        give_back()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def _planes_of(ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Byte planes of each text's ids (one at least), up to the highest that is used,
    after their number."""
    if len(bounds) < 2:
        return []
    most = np.maximum.reduceat(ids, bounds[:-1])
    used = (1 + (most > 0xFF) + (most > 0xFFFF) + (most > 0xFFFFFF)).tolist()
    raw, at = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4), bounds.tolist()
    return [bytes([n]) + raw[a:b, :n].T.tobytes() for n, a, b in zip(used, at, at[1:])]


def _from_planes(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    return sum(planes[i].astype(np.uint32) << np.uint32(8 * i) for i in range(raw[0]))


def id_counts(tokens: DataFrame) -> DataFrame:
    """(id, n): how often each id is in the corpus; a task sends its own sums."""
    def run(batches):
        total = np.zeros(0, np.int64)
        for whole in batches:
            for batch in pieces(whole, "ids", SEGMENT_BYTES):
                # many documents at a time: a count is as long as the vocabulary
                own = np.bincount(np.concatenate([_from_planes(raw) for raw in batch.column("ids").to_pylist()]))
                if len(own) > len(total):
                    total = np.pad(total, (0, len(own) - len(total)))
                total[:len(own)] += own
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(held, pa.int64()), "n": pa.array(total[held], pa.int64())})
    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Tokenizes ``docs`` once, counts the ids, and writes the files to ``folder``."""
    spark = docs.sparkSession
    plain = shared_path(spark, "tokenized")
    tokenized(docs, tokenizer_path, end_id).write.option("compression", "zstd").parquet(plain)
    tokens = spark.read.schema("doc_id long, ids binary").parquet(plain)
    # one row for each id of the vocabulary: its size bounds what the driver holds
    by_rank = [r["id"] for r in id_counts(tokens).orderBy(F.desc("n"), "id").select("id").collect()]
    spark.createDataFrame([(r, i) for r, i in enumerate(by_rank)], "rank int, id int").coalesce(1).write.parquet(
        f"{folder}/ranks")
    rank = np.zeros(max(by_rank, default=0) + 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank))

    def run(batches):
        segment = 0
        for whole in batches:
            for batch in pieces(whole, "ids", SEGMENT_BYTES):
                lists = [_from_planes(raw.as_py()) for raw in batch.column("ids")]
                ids = np.concatenate(lists)
                control, data = encode_ranks(rank[ids])
                edge = np.array([0, batch.num_rows])
                yield pa.RecordBatch.from_arrays([
                    batch.column("shard").slice(0, 1), pa.array([segment], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(edge, pa.int32()), batch.column("doc_id")),
                    ragged(edge, np.array([len(x) for x in lists], np.int64), pa.int64()),
                    pa.array([len(ids)], pa.int64()), pa.array([control], pa.binary()), pa.array([data], pa.binary()),
                ], ["shard", "segment", "doc_ids", "counts", "n_tokens", "control", "data"])
                segment += 1
    shards = block_count(text_size(tokens, "ids"), SHARD_BYTES)
    ordered = (tokens.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions("doc_id")
               .select("doc_id", "ids", F.spark_partition_id().alias("shard")))
    ordered.mapInArrow(run, "shard int, segment int, doc_ids array<long>, counts array<long>, n_tokens long, "
                            "control binary, data binary").write.parquet(f"{folder}/tokens")


def read_token_files(spark: SparkSession, folder: str, then=lambda batch: batch,
                     schema: str = "doc_id long, start long, ids array<int>") -> DataFrame:
    """(doc_id, start, ids) of each document in the files, ``start`` counting the
    ids of all documents before it; ``then``: what to make of each batch of them, in
    the task that reads it, and the ``schema`` of that."""
    by_rank = np.array([r["id"] for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()], np.int32)
    tokens = spark.read.schema(
        "shard int, segment int, doc_ids array<long>, counts array<long>, n_tokens long, control binary, data binary"
    ).parquet(f"{folder}/tokens")
    shards = tokens.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    segments = tokens.select("shard", "segment", "n_tokens").withColumn(
        "inner_start", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    starts = segments.join(shards, "shard").select("shard", "segment",
                                                   (F.col("shard_start") + F.col("inner_start")).alias("start"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = by_rank[decode_ranks(row["control"], row["data"], row["n_tokens"])]
                bounds = np.concatenate([[0], np.cumsum(row["counts"], dtype=np.int64)])
                yield then(pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + bounds[:-1]),
                     ragged(bounds, ids, pa.int32())], ["doc_id", "start", "ids"]))
    few = segments.count() <= MOST_BROADCAST
    return tokens.join(F.broadcast(starts) if few else starts, ["shard", "segment"]).select(
        "doc_ids", "counts", "n_tokens", "control", "data", "start").mapInArrow(
        run, schema)


def _checksums(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids = batch.column("ids")
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
    at = np.asarray(ids.offsets) - np.asarray(ids.offsets)[0]
    crc = [zlib.crc32(flat[a:b]) for a, b in zip(at, at[1:])]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())],
        ["doc_id", "start", "n_tokens", "ids_crc32"])


def op5_token_files(spark, sf_dir):
    import public_tokenizers
    folder = shared_path(spark, "token-files")
    write_token_files(documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, folder, _checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
