"""Operator 3: near-duplicate documents by MinHash with tensored banding.

A document is the set of its distinct five-word shingles (lower case A-Z).  Two
collections of ``side`` signatures, each of ``rows`` minhashes, are computed; the
table keys are the ``side * side`` pairs of a signature of the first and one of
the second, so 2 * side * rows minhashes do the work of side * side * 2 * rows.
At similarity s a pair shares no table with probability
1 - (1 - (1 - s**rows) ** side) ** 2: under 2e-6 at 0.85 with the defaults.

Steps, each a Spark job over tables:

1. Documents with equal sets collapse to the one with the smallest id.
2. A signature that only one set has can be in no shared key: sets without a
   shared signature on both sides have no candidates.
3. Of the rest, a set can be linked only if ``percent`` of its shingles are in
   other sets, too.  Blocks of sets send their distinct shingles once and learn
   which ones other blocks have; sets with too many shingles of their own go.
   This is exact, and takes most documents that merely share a passage.
4. The sets left form table keys.  Members of a key point to its smallest id;
   connected components of these pointers are candidate groups, and any two
   sets that share a key are in one group.
5. Groups are verified on full sets.  A group above ``chunk`` sets is dealt into
   chunks, and each pair of chunks is a task of its own, so a task holds
   2 * chunk sets whatever the group's size.  A task returns a spanning forest
   of the links it finds, never all pairs.
6. Components of these links give each document its smallest reachable id.

Fewer words than a shingle: the whole sequence is the one shingle.  No words or
null text: linked with nothing.  Null ``doc_id``: left out of the result, as
there is no id to link.  Rows that share a ``doc_id`` count as one document with
the union of links of all; one row per ``doc_id`` is returned.  An empty table
gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (LOWER, U64, Words, asking_blocks, block_of, dealt_by, documents, mix, pieces, span_hashes,
                     text_bytes, text_size, written)
from .substring_dedup import from_planes, planes

SHINGLE = 5
PERCENT = 85
#: Similarity of near duplicates that ``keep_one`` drops: a pair at it shares no table with probability 5.4e-5.
KEEP_PERCENT = 80
ROWS = 4
SIDE = 20
BLOCK_BYTES = 4 << 20
#: Sets of a candidate group that one side of a verification task holds.
CHUNK = 256


def shingle_sets(batch, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and their offsets."""
    words = Words(*text_bytes(batch.column("text")))
    hashes = words.hashes(LOWER)
    at = words.windows(shingle)
    grams, of = span_hashes(hashes, at, at + shingle), words.document()[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < shingle))
    grams = np.concatenate([grams, span_hashes(hashes, words.first[short], words.first[short + 1])])
    of = np.concatenate([of, short])
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    grams, of = grams[new], of[new]
    return grams, np.searchsorted(of, np.arange(len(words.counts) + 1))


def _signatures(shingle: int, rows: int, side: int):
    factors = mix(np.arange(1, 2 * rows * side + 1, dtype=U64)) | U64(1)

    def run(batches):
        for whole in batches:
            for batch in pieces(whole):
                grams, edge = shingle_sets(batch, shingle)
                n = batch.num_rows
                held = np.flatnonzero(np.diff(edge))
                least = np.empty((2 * rows * side, n), U64)
                for i, factor in enumerate(factors):
                    if len(held):
                        least[i, held] = np.minimum.reduceat(grams * factor, edge[held])
                ends = np.concatenate([[U64(0)], np.cumsum(grams, dtype=U64)])
                turned = np.concatenate([[U64(0)], np.cumsum(mix(grams + U64(1)), dtype=U64)])
                signature = np.zeros((2 * side, n), U64)
                for i in range(2 * side):
                    signature[i] = U64(i + 1)
                    for r in range(rows):
                        signature[i] = mix(signature[i] * U64(3) + least[i * rows + r])
                some = np.diff(edge) > 0
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id"),
                    "n_shingles": pa.array(np.diff(edge), pa.int64()),
                    "set_a": pa.array(np.diff(ends[edge]).view(np.int64)),
                    "set_b": pa.array(np.diff(turned[edge]).view(np.int64)),
                    "signatures": pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], np.cumsum(some * 2 * side)]).astype(np.int32)),
                        pa.array(np.ascontiguousarray(signature.T[some]).ravel().view(np.int64))),
                })
    return run


def signatures(docs: DataFrame, shingle: int = SHINGLE, rows: int = ROWS, side: int = SIDE) -> DataFrame:
    """Set size, set fingerprint (two 64-bit sums) and signatures of each document."""
    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _signatures(shingle, rows, side),
        "doc_id long, n_shingles long, set_a long, set_b long, signatures array<long>")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, component): the smallest id reachable over ``edges`` (a, b).  Each
    round takes the smallest label of the neighbours and of the label's own
    label; rounds end when nothing changes.  Labels are written each round."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))),
                   f"{name}-edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
                     .select("id", F.least("id", "m").alias("component")), f"{name}-labels")
    while True:
        near = (both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near")))
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("up"))
        new = (labels.join(near, labels["id"] == near["a"], "left").drop("a").join(up, "component", "left")
               .select("id", F.least("component", "near", "up").alias("new"),
                       F.col("component").alias("old")))
        new = written(new, f"{name}-labels")
        labels = new.select("id", F.col("new").alias("component"))
        if not new.where("new != old").limit(1).count():
            return labels


def shared_signatures(sets: DataFrame, side: int = SIDE) -> DataFrame:
    """(doc_id, one, two): of each set the signatures that other sets have, too,
    where there are some on both sides."""
    halves = sets.select("doc_id", F.posexplode("signatures").alias("place", "signature"))
    shared = (halves.groupBy("signature").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
              .where("least < most").select("signature"))
    return (halves.join(shared, "signature").groupBy("doc_id")
            .agg(F.collect_list(F.when(F.col("place") < side, F.col("signature"))).alias("one"),
                 F.collect_list(F.when(F.col("place") >= side, F.col("signature"))).alias("two"))
            .where((F.size("one") > 0) & (F.size("two") > 0)))


def _ranges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    bucket = ((hashes >> U64(32)) * U64(buckets)) >> U64(32)
    return np.searchsorted(bucket, np.arange(buckets + 1, dtype=U64))


def _send(shingle: int, buckets: int):
    def send(table: pa.Table) -> pa.Table:
        hashes = np.unique(shingle_sets(table, shingle)[0])
        cut = _ranges(hashes, buckets)
        sent = [b for b in range(buckets) if cut[b] < cut[b + 1]]
        return pa.table({
            "bucket": pa.array(sent, pa.int32()),
            "block": pa.array([table["block"][0].as_py()] * len(sent), pa.int32()),
            "hashes": pa.array([planes(np.diff(hashes[cut[b]:cut[b + 1]], prepend=U64(0))) for b in sent],
                               pa.binary())})
    return send


def _elsewhere(table: pa.Table) -> pa.Table:
    """For one range of hashes: which entries more than one block has."""
    hashes = [np.cumsum(from_planes(x.as_py(), U64), dtype=U64) for x in table["hashes"]]
    size = np.cumsum([0] + [len(x) for x in hashes])
    _, entry, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    shared = count[entry] > 1
    return pa.table({"block": table["block"], "bucket": table["bucket"], "shared": pa.array(
        [np.packbits(shared[a:b]).tobytes() for a, b in zip(size, size[1:])], pa.binary())})


def _survivors(shingle: int, percent: int, buckets: int):
    def survivors(table: pa.Table, answers: pa.Table) -> pa.Table:
        grams, edge = shingle_sets(table, shingle)
        hashes, entry, count = np.unique(grams, return_inverse=True, return_counts=True)
        shared, cut = count > 1, _ranges(hashes, buckets)
        for bucket, bits in zip(answers["bucket"].to_pylist(), answers["shared"].to_pylist()):
            a, b = cut[bucket], cut[bucket + 1]
            shared[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        held = np.concatenate([[0], np.cumsum(shared[entry])])[edge]
        kept = np.flatnonzero(100 * np.diff(held) >= percent * np.diff(edge))
        return pa.table({"doc_id": table["doc_id"].take(pa.array(kept)),
                         "grams": pa.array([grams[edge[i]:edge[i + 1]].tobytes() for i in kept], pa.binary())})
    return survivors


def linkable_sets(docs: DataFrame, candidates: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, grams) of the candidates (doc_id) that share enough shingles with
    other candidates to be linked with any."""
    blocks = asking_blocks(text_size(docs), block_bytes)
    dealt = dealt_by(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                     .join(candidates.hint("merge"), "doc_id")  # the same plan at every size
                     .withColumn("block", block_of(blocks, "doc_id")), "block", blocks)
    sent = dealt.groupBy("block").applyInArrow(_send(shingle, blocks), "bucket int, block int, hashes binary")
    answers = dealt_by(sent, "bucket", blocks).groupBy("bucket").applyInArrow(
        _elsewhere, "block int, bucket int, shared binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _survivors(shingle, percent, blocks), "doc_id long, grams binary")


def candidate_edges(mine: DataFrame) -> DataFrame:
    """(a, b): pointers from each set to the smallest ids of its shared keys.  A set
    points to one of them, and that one to the others: the components are the
    same, and a group of n sets has about n pointers, not one for each key."""
    keys = (mine.select("doc_id", "two", F.explode("one").alias("first"))
            .select("doc_id", "first", F.explode("two").alias("second"))
            .select("doc_id", F.xxhash64("first", "second").alias("key")))
    least = (keys.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("most"))
             .where("a < most").select("key", "a"))
    ends = keys.join(least, "key").groupBy("doc_id").agg(F.collect_set("a").alias("ends"))
    ends = ends.withColumn("a", F.array_min("ends"))
    others = ends.select("a", F.explode("ends").alias("b")).where("a != b").distinct()
    return ends.where("a != doc_id").select("a", F.col("doc_id").alias("b")).unionByName(others)


def _links(one: list[np.ndarray], two: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Links found, as a spanning forest over positions (``two`` after ``one``)."""
    sets = one + (two or [])
    n, cut = len(sets), len(one) if two is not None else 0
    size = np.array([len(s) for s in sets])
    of = np.repeat(np.arange(n), size)
    shingle, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    of, column = of[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    both = np.zeros((n, n), np.float32)
    total, width = int(shared.sum()), 4096
    for begin in range(0, total, width):
        a, b = np.searchsorted(column, [begin, begin + width])
        part = np.zeros((n, min(width, total - begin)), np.float32)
        part[of[a:b], column[a:b] - begin] = 1
        both += part @ part.T
    union = size[:, None] + size[None, :] - both
    linked = 100 * both >= percent * union
    root = list(range(n))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(*np.nonzero(np.triu(linked, 1))):
        if (not cut or x < cut <= y) and (a := top(x)) != (b := top(y)):
            root[max(a, b)] = min(a, b)
            out.append((int(x), int(y)))
    return out


def _verify(percent: int):
    def task(held):
        ids, sets, chunk, low, high = held
        if low == high:
            return [(ids[x], ids[y]) for x, y in _links(sets, None, percent)]
        first = [i for i, c in enumerate(chunk) if c == low]
        second = [i for i, c in enumerate(chunk) if c == high]
        if not first or not second:
            return []
        names = [ids[i] for i in first + second]
        return [(names[x], names[y]) for x, y in
                _links([sets[i] for i in first], [sets[i] for i in second], percent)]

    def run(batches):
        """Rows come sorted by task: one task's rows are held at a time."""
        now, held = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("task", "low", "high", "chunk", "doc_id", "grams")]
            edges = []
            for key, low, high, chunk, doc, grams in zip(*columns):
                if (key, low, high) != now:
                    edges += task(held) if held else []
                    now, held = (key, low, high), ([], [], [], low, high)
                held[0].append(doc)
                held[1].append(np.frombuffer(grams, U64))
                held[2].append(chunk)
            yield _edges(edges)
        if held:
            yield _edges(task(held))
    return run


def _edges(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([min(e) for e in edges], pa.int64()),
                                       "b": pa.array([max(e) for e in edges], pa.int64())})


def verified_links(sets: DataFrame, groups: DataFrame, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """(a, b) links between sets (doc_id, grams) of one group (id, component)."""
    size = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    placed = groups.join(size, "component").select(
        F.col("id").alias("doc_id"), F.col("component").alias("task"), "chunks")
    dealt = (sets.join(placed, "doc_id")
             .withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .select("task", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"),
                     "chunk", "doc_id", "grams"))
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "task", "low", "high").sortWithinPartitions("task", "low", "high")
    return dealt.mapInArrow(_verify(percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, rows: int = ROWS,
                    side: int = SIDE, chunk: int = CHUNK) -> DataFrame:
    """A row for each document: ``n_shingles``, ``component_id`` and ``kept``."""
    found = written(signatures(docs, shingle, rows, side), "minhash-sets")
    same = found.where("n_shingles > 0").groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("least"))
    members = found.select("doc_id", "n_shingles", "set_a", "set_b")
    twins = (members.join(same, ["n_shingles", "set_a", "set_b"]).where("doc_id != least")
             .select(F.col("least").alias("a"), F.col("doc_id").alias("b")))
    sets = found.join(same.select(F.col("least").alias("doc_id"), "n_shingles", "set_a", "set_b"),
                      ["doc_id", "n_shingles", "set_a", "set_b"], "left_semi")
    mine = written(shared_signatures(sets, side), "minhash-signatures")
    linkable = written(linkable_sets(docs, mine.select("doc_id"), percent, shingle), "minhash-linkable")
    edges = candidate_edges(mine.join(linkable.select("doc_id"), "doc_id", "left_semi"))
    links = verified_links(linkable, components(edges, "minhash-groups"), percent, chunk)
    labels = components(links.unionByName(twins), "minhash-links")
    out = (members.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
           .join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
           .withColumn("component_id", F.coalesce("component", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id",
                      (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = KEEP_PERCENT) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    gone = near_duplicates(docs, percent).where("NOT kept").select(F.col("doc_id").alias("__doc_id"))
    return docs.join(gone, docs["doc_id"] == gone["__doc_id"], "left_anti")


def op3_minhash(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))
