"""Operator 4: byte-level BPE encoding and decoding.

Distinct pieces (matches of the tokenizer's pattern) are encoded once: Spark
higher-order functions fold the ranked merges over the piece's bytes, looking
ranks up in a literal map.  A merge list is what a piece's byte spans that are
in the vocabulary give, in order of rank and place; a span merges when both its
ends are still token borders.  That is the tokenizer's own rule: by the time a
span's rank comes, all lower ranks are merged, so two borders enclose exactly
the two parts that the merge joins.

Documents are dealt into blocks; each block names its distinct pieces, Spark
encodes every distinct piece of the corpus, and each block gets the ids of its
own pieces back.  A block takes its documents from one or a few input partitions, so
that a task packs for few blocks and names a block's pieces once, not a little of
each for all blocks.  No dictionary is broadcast or collected.  What is dealt out
travels in compressed packs: texts as their distinct pieces and numbers into them,
sorted pieces, and ids in the order of the pieces they answer.  The result is written
to the shared folder and read from there.

A piece that is a token of its own is that token.  Other pieces of up to 62 bytes
are folded with their borders in the bits of a long.  Longer ones (text without
blanks, encoded data) would take a fold quadratic time: Spark leaves them out, and
the task that answers merges them with linked neighbours and a heap of pairs.
Letters are those of Java's Unicode tables; characters added to Unicode later
may be split differently by a library with newer tables.

Null or empty text: no ids, empty decoded bytes.  A text, or a piece, may have any
length.  Null and repeated ``doc_id``:
each row is encoded by itself.  An empty table gives no rows.  Other columns are
ignored.
"""

from __future__ import annotations

import base64
import contextlib
import heapq
import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (SLICE_BYTES, U64, asking_blocks, block_of, dealt_by, documents, give_back, ragged, span_hashes,
                     text_bytes, written)

#: Bytes of text in a block: larger blocks repeat fewer pieces and need more memory.
BLOCK_BYTES = 8 << 20
#: Bytes of text that a task gathers before it packs them by block.
GATHER_BYTES = 8 << 20
#: Bytes of a batch between Spark and a Python worker (a longer row is alone): both hold
#: it whole, Spark outside its heap and in buffers that double.
BATCH_BYTES = 4 << 20
#: Lists that are put one after the other at once.
LISTS_AT_ONCE = 1 << 17
#: Pieces that travel to the fold in one row.
PIECES_A_ROW = 2000
LEVEL = 6
BUCKETS = 1 << 13
_LONGEST_BITS = 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def java_pattern(pattern: str) -> str:
    """The tokenizer's pattern with its white space spelled as Java's property."""
    return pattern.replace("\\s", "\\p{IsWhite_Space}").replace("\\S", "\\P{IsWhite_Space}")


def split_pieces(text: str, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))


def rank_map_sql(ranks: dict[bytes, int]) -> str:
    """The rank map as a literal: maps of hexadecimal pieces, in buckets by CRC-32
    because a literal map is searched from its start.  Keys are binary: parts of a
    binary are cut by place, those of a string by walking its characters."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        key = token.hex().upper()
        buckets[zlib.crc32(key.encode()) % BUCKETS][key] = rank
    table = json.dumps(buckets, separators=(',', ':'))
    return f"cast(from_json('{table}', 'array<map<string,int>>') as array<map<binary,int>>)"


def fold_sql(ranks: dict[bytes, int], pieces: str = "pieces") -> str:
    """SQL for the ids of each piece of an array; null for one that is too long to fold.
    A span is a long: its rank, then six bits each for its start and its end."""
    table, longest = rank_map_sql(ranks), max(map(len, ranks))

    def rank(key: str) -> str:
        return f"get(m, cast(crc32({key}) & {BUCKETS - 1} as int))[{key}]"

    spans = f"""flatten(transform(sequence(0, n - 2), s ->
        array_compact(transform(sequence(s + 2, least(n, s + {longest})), e ->
            shiftleft(cast({rank("substring(h, 2 * s + 1, 2 * (e - s))")} as bigint), 12) | (64 * s + e)))))"""
    borders = f"""aggregate(transform(sort_array({spans}), c -> named_struct(
            's', cast(shiftright(c, 6) & 63 as int), 'e', cast(c & 63 as int))), -1L, (b, c) -> CASE
        WHEN shiftright(b, c.s) & shiftright(b, c.e) & 1L = 1L
        THEN b & ~shiftleft(shiftleft(1L, c.e - c.s - 1) - 1L, c.s + 1) ELSE b END)"""
    fold = f"""transform(transform(array({borders}), b -> filter(sequence(0, n),
        i -> shiftright(b, i) & 1L = 1L)), c -> transform(sequence(0, size(c) - 2),
        j -> {rank("substring(h, 2 * c[j] + 1, 2 * (c[j + 1] - c[j]))")}))[0]"""
    folded = f"transform(array(cast(octet_length(h) div 2 as int)), n -> CASE WHEN n <= {_LONGEST_BITS} THEN {fold} END)[0]"
    one = f"transform(array({rank('h')}), w -> CASE WHEN w IS NULL THEN {folded} ELSE array(w) END)[0]"
    each = f"transform(transform({pieces}, p -> cast(hex(cast(p as binary)) as binary)), h -> {one})"
    return f"transform(array({table}), m -> {each})[0]"


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the pair of lowest rank, the first of equal ones, is merged
    until none is left; n log n in the piece's length."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, upto = heapq.heappop(heap)
        right = after[i]
        if end[i] < 0 or right >= n or end[right] != upto:  # one of the two has been merged since
            continue
        end[i], end[right] = upto, -1
        after[i] = upto
        if upto < n:
            before[upto] = i
            r = ranks.get(piece[i:end[upto]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[upto]))
        left = before[i]
        if left >= 0:
            r = ranks.get(piece[left:upto])
            if r is not None:
                heapq.heappush(heap, (r, left, upto))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


# --------------------------------------------------------------------------- packs

def _pack(table: pa.Table | pa.RecordBatch) -> bytes:
    import zstandard
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write(table)
    return zstandard.ZstdCompressor(level=LEVEL).compress(sink.getvalue())


def _unpack(blob: bytes) -> pa.Table:
    import zstandard
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()


def _byte_planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _strings(sizes: np.ndarray, data: bytes) -> pa.LargeStringArray:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(data))


def _pack_documents(batches):
    """Rows (block, doc_id, pieces) to packs, one for each block of what was gathered."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush():
        table = pa.Table.from_batches(held)
        blocks = table["block"].to_numpy()
        for block in np.unique(blocks):
            rows = table.filter(pa.array(blocks == block))
            pieces = rows["pieces"].combine_chunks()
            coded = pc.dictionary_encode(pieces.flatten())
            # in order of their bytes, the distinct pieces pack well
            order = pc.sort_indices(coded.dictionary)
            place = np.empty(len(order), np.int32)
            place[order.to_numpy()] = np.arange(len(order))
            data, ends = text_bytes(coded.dictionary.take(order))
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "pack": pa.array([_pack(
                pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([rows["doc_id"].to_pylist()], pa.list_(pa.int64())),
                    "counts": pa.array([_byte_planes(np.diff(np.asarray(pieces.offsets)))], pa.binary()),
                    "codes": pa.array([_byte_planes(place[coded.indices.to_numpy()])], pa.binary()),
                    "sizes": pa.array([_byte_planes(np.diff(ends))], pa.binary()),
                    "data": pa.array([data.tobytes()], pa.large_binary())}))], pa.binary())})

    for batch in batches:
        for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
            held.append(part)
            size += part.nbytes
            if size >= GATHER_BYTES:
                yield from flush()
                held, size = [], 0
                give_back()
        # what waits is copied, so that the batch it came in can go
        held = pa.Table.from_batches(held).combine_chunks().to_batches() if len(held) > 1 else held
        batch = part = None
        give_back()
    if held:
        yield from flush()
    held = []
    give_back()


def _documents(table: pa.Table):
    """(doc_ids, counts, codes, distinct pieces) of each pack of a block."""
    for blob in table["pack"]:
        row = _unpack(blob.as_py()).to_pylist()[0]
        yield (row["doc_id"], _from_planes(row["counts"]), _from_planes(row["codes"]),
               _strings(_from_planes(row["sizes"]), row["data"]))


def _coded_once(parts: list[pa.Array]) -> tuple[pa.LargeStringArray, list[np.ndarray]]:
    """The distinct strings of all parts, and each part's places among them: one
    table of strings, however many parts there are."""
    coded = pc.dictionary_encode(pa.concat_arrays([pa.array([], pa.large_string()), *parts]))
    return coded.dictionary, np.split(coded.indices.to_numpy(), np.cumsum([len(part) for part in parts])[:-1])


def _hashes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of texts that lie one after the other, a slice of them at a time."""
    out, begin = np.empty(len(ends) - 1, U64), 0
    while begin < len(out):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + SLICE_BYTES, side="right")) - 1)
        at = ends[begin:end + 1] - ends[begin]
        out[begin:end] = span_hashes(data[ends[begin]:ends[end]], at[:-1], at[1:])
        begin = end
    return out


def _by_bucket(parts: list[pa.Array], buckets: int) -> tuple[pa.LargeStringArray, np.ndarray, list[np.ndarray]]:
    """A block's distinct pieces, sorted within hash buckets, the buckets' bounds, and
    the places of each pack's pieces."""
    distinct, places = _coded_once(parts)
    order = pc.sort_indices(distinct).to_numpy()
    data, ends = text_bytes(distinct)
    bucket = (((_hashes(data, ends) >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)
    order = order[np.argsort(bucket[order], kind="stable")]
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    return (distinct.take(pa.array(order)), np.searchsorted(bucket[order], np.arange(buckets + 1)),
            [place[own] for own in places])


def _name(buckets: int):
    def name(table: pa.Table) -> pa.Table:
        pieces, cut, _ = _by_bucket([own for *_, own in _documents(table)], buckets)
        sent = [b for b in range(buckets) if cut[b] < cut[b + 1]]
        give_back()
        return pa.table({
            "bucket": pa.array(sent, pa.int32()),
            "block": pa.array([table["block"][0].as_py()] * len(sent), pa.int32()),
            "pack": pa.array([_pack(pa.table({"piece": pieces.slice(cut[b], cut[b + 1] - cut[b])})) for b in sent],
                             pa.binary())})
    return name


QUESTIONS = "bucket int, pieces array<string>, packs array<struct<block:int,places:binary>>"


def _questions(table: pa.Table) -> pa.Table:
    """Rows of a bucket: its distinct pieces, then who asked for which, by their places."""
    distinct, places = _coded_once([_unpack(blob.as_py())["piece"].combine_chunks() for blob in table["pack"]])
    distinct = distinct.cast(pa.string())
    ends = np.append(np.arange(0, len(distinct), PIECES_A_ROW), len(distinct))
    ends = np.append(ends, len(distinct))
    n = len(ends) - 1
    asked = pa.StructArray.from_arrays([table["block"].combine_chunks(), pa.array(
        [own.astype("<i4").tobytes() for own in places], pa.binary())], ["block", "places"])
    packs = pa.ListArray.from_arrays(pa.array(np.append(np.zeros(n, np.int32), len(asked)).astype(np.int32)), asked)
    del places
    give_back()
    return pa.table({"bucket": pa.array(np.full(n, table["bucket"][0].as_py()), pa.int32()),
                     "pieces": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), distinct), "packs": packs})


class _Lists:
    """Lists of numbers, to be put one after the other."""

    def __init__(self, starts: np.ndarray, sizes: np.ndarray, values: np.ndarray):
        self.starts, self.sizes, self.values = starts, sizes, values

    def gather(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists at ``place``: their ends, from 0 on, and their values one after the
        other.  A slice of the lists at a time: a value's place takes eight bytes."""
        ends = np.zeros(len(place) + 1, np.int64)
        np.cumsum(self.sizes[place], out=ends[1:])
        values = np.empty(ends[-1], self.values.dtype)
        for begin in range(0, len(place), LISTS_AT_ONCE):
            own = place[begin:begin + LISTS_AT_ONCE]
            first, last = ends[begin], ends[begin + len(own)]
            at = np.repeat(self.starts[own] - ends[begin:begin + len(own)], self.sizes[own])
            at += np.arange(first, last)
            values[first:last] = self.values[at]
        return ends, values


def _answers(ranks: dict[bytes, int]):
    """To each block of a bucket the ids of its pieces, in their order.  The rows of
    a bucket follow each other, the last one says who asked."""
    def filled(pieces: pa.Array, ids: pa.ListArray) -> pa.ListArray:
        """Ids with those of the pieces that Spark did not fold."""
        missing = np.flatnonzero(np.asarray(ids.is_null()))
        if not len(missing):
            return ids
        lists = ids.to_pylist()
        for i in missing:
            lists[i] = merge(pieces[int(i)].as_py().encode(), ranks)
        return pa.array(lists, ids.type)

    def answer(ids: pa.ListArray, bucket: int, packs: list) -> pa.RecordBatch:
        at = np.asarray(ids.offsets).astype(np.int64)
        lists = _Lists(at[:-1] - at[0], np.diff(at), ids.flatten().to_numpy(zero_copy_only=False))
        out = []
        for pack in packs:
            ends, values = lists.gather(np.frombuffer(pack["places"], "<i4"))
            out.append(_pack(pa.RecordBatch.from_pydict({"sizes": pa.array([_byte_planes(np.diff(ends))], pa.binary()),
                                                         "ids": pa.array([_byte_planes(values)], pa.binary())})))
        return pa.RecordBatch.from_pydict({
            "block": pa.array([p["block"] for p in packs], pa.int32()),
            "bucket": pa.array([bucket] * len(packs), pa.int32()), "pack": pa.array(out, pa.binary())})

    def run(batches):
        ids = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids.append(filled(row.column("pieces").flatten(), row.column("ids").flatten()))
                packs = row.column("packs")[0].as_py()
                if packs:
                    yield answer(pa.concat_arrays(ids), batch.column("bucket")[i].as_py(), packs)
                    ids, row, packs = [], None, None
                    give_back()
    return run


def _replace(buckets: int, then):
    def replace(table: pa.Table, answers: pa.Table) -> pa.Table:
        packs, own = [], []
        for *numbers, pieces in _documents(table):
            packs.append(numbers)
            own.append(pieces)
        _, _, places = _by_bucket(own, buckets)
        own = pieces = None
        sizes, ids = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for _, blob in sorted(zip(answers["bucket"].to_pylist(), answers["pack"].to_pylist())):
            row = _unpack(blob).to_pylist()[0]
            sizes.append(_from_planes(row["sizes"]))
            ids.append(_from_planes(row["ids"]))
        sizes = np.concatenate(sizes)
        coded = _Lists(np.cumsum(sizes) - sizes, sizes, np.concatenate(ids))
        del ids
        out = []
        for place in places:
            doc_ids, counts, codes = packs.pop(0)
            ends, values = coded.gather(place[codes])
            ends = ends[np.concatenate([[0], np.cumsum(counts)])]
            out.append(then(pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), ragged(ends, values, pa.int32())],
                                                       ["doc_id", "ids"])))
        packs = places = place = coded = codes = ends = values = None
        give_back()
        return pa.Table.from_batches(out)
    return replace


@contextlib.contextmanager
def _set(spark, name: str, value: str):
    """A setting of the session while a job runs."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _short_plans(spark):
    """While a job runs, plans are printed in short: the literal map makes a plan's
    printed form megabytes long, which the driver keeps for each run of it."""
    return _set(spark, "spark.sql.maxPlanStringLength", "100000")


def _small_batches(spark):
    """While a job runs, batches for the Python workers have few bytes, however long
    their texts: by default it is the rows that are counted."""
    return _set(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def in_blocks(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """(block, doc_id, text), and the number of blocks: equal shares of the text in
    the order of the input's partitions, a row's place in its partition by hash.  A row
    is in the same block whenever its partition has the same rows; sizes that no longer
    hold make blocks uneven, no more."""
    partition = F.spark_partition_id().alias("partition")
    # one row for each partition
    parts = docs.groupBy(partition).agg(F.sum(F.octet_length("text")).alias("size")).orderBy("partition").collect()
    sizes = [r["size"] or 0 for r in parts]
    starts = np.cumsum([0, *sizes]).tolist()
    blocks = asking_blocks(starts[-1], block_bytes)
    # from Arrow, rows need no Python worker: one more of them would wait on every executor
    known = docs.sparkSession.createDataFrame(pa.table({
        "partition": pa.array([r["partition"] for r in parts], pa.int32()),
        "start": pa.array(starts[:-1], pa.int64()), "size": pa.array(sizes, pa.int64())}))
    # the text counts too: rows of one id, or of none, go to many places
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = F.floor((F.col("start") + F.col("size") * place) * F.lit(blocks / max(starts[-1], 1))).cast("int")
    rows = docs.select(partition, F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.join(F.broadcast(known), "partition", "left").select(
        F.coalesce(F.least(share, F.lit(blocks - 1)), block_of(blocks, "doc_id", "text")).alias("block"),
        "doc_id", "text"), blocks


def _coded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, block_bytes: int, then, schema: str,
           finish=lambda df: df) -> DataFrame:
    rows, blocks = in_blocks(docs, block_bytes)
    packs = rows.select("block", "doc_id", split_pieces("text", pattern).alias("pieces")).mapInArrow(
        _pack_documents, "block int, pack binary")
    dealt = dealt_by(packs, "block", blocks)
    named = dealt_by(dealt.groupBy("block").applyInArrow(_name(blocks), "bucket int, block int, pack binary"),
                     "bucket", blocks)
    asked = named.groupBy("bucket").applyInArrow(_questions, QUESTIONS)
    answers = asked.select("bucket", "pieces", F.expr(fold_sql(ranks)).alias("ids"), "packs").mapInArrow(
        _answers(ranks), "block int, bucket int, pack binary")
    out = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_replace(blocks, then), schema)
    with _short_plans(docs.sparkSession), _small_batches(docs.sparkSession):
        return written(finish(out), "byte-bpe")


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, ids): the ids of each whole text."""
    return _coded(docs, ranks, pattern, block_bytes, lambda batch: batch, "doc_id long, ids array<int>")


DECODED = "doc_id long, n_tokens long, raw binary, decoded binary"


def _decoder(ranks: dict[bytes, int]):
    by_id = sorted(ranks.items(), key=lambda item: item[1])
    data = np.frombuffer(b"".join(token for token, _ in by_id), np.uint8)
    sizes = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
    sizes[[rank for _, rank in by_id]] = [len(token) for token, _ in by_id]
    tokens = _Lists(np.cumsum(sizes) - sizes, sizes, data)

    def decode_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("ids")
        flat, at = ids.flatten().to_numpy(zero_copy_only=False), np.asarray(ids.offsets)
        at = at - at[0]
        ends, text = tokens.gather(flat)
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array(np.diff(at), pa.int64()), _binary(4 * at.astype(np.int64), flat.astype("<u4")),
            _binary(ends[at], text)], ["doc_id", "n_tokens", "raw", "decoded"])
    return decode_batch


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, n_tokens, raw, decoded): the ids as little-endian unsigned 32-bit
    integers, and the binary pieces of the ids, concatenated."""
    decode_batch = _decoder(ranks)

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                yield decode_batch(batch.slice(begin, 200))
    return encoded.select("doc_id", "ids").mapInArrow(run, DECODED)


def encode_and_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str,
                      block_bytes: int = BLOCK_BYTES, finish=lambda df: df) -> DataFrame:
    """``finish`` of :func:`decode` of :func:`encode`, in one task for each block."""
    return _coded(docs, ranks, pattern, block_bytes, _decoder(ranks), DECODED, finish)


def _binary(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    """Binary values of a few rows from one buffer."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [
        None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", "n_tokens", F.sha2("raw", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


def round_trip(docs: DataFrame) -> DataFrame:
    """Encoded and decoded again with the public vocabulary; digests of both."""
    import public_tokenizers
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return encode_and_decode(docs, ranks, public_tokenizers.PATTERN, finish=digests)


def op4_byte_bpe(spark, sf_dir):
    return round_trip(documents(spark, sf_dir))
