"""Operator 8: hashed maximum-entropy language model with class-factored softmax.

Every token (lower-case words, then one end) belongs to one of 256 cells, 16 in
each of 16 classes: the most frequent words have a cell of their own, all others
share the cell of their last two letters.  The model gives

    P(token | h) = P(class | h) * P(cell | class, h) * P(token | cell)

where the first two are softmaxes over weights of hashed features of the history
h (the word before, the two words before, and the word before the last, skipping
it) and the last is the token's smoothed share of its cell.  So the work for a
token is two softmaxes of 16, however large the vocabulary.

Training runs in rounds over all training documents, each document in one round:
every task takes gradient steps (AdaGrad) from the common weights over its rows,
and Spark averages the tasks' changes, weighted by how often each feature row
was seen.  The weight table has a fixed size, which bounds what is sent to the
driver and to tasks.

Counts are exact and cover all training documents: documents are dealt into
blocks; each block sends its distinct words once and gets their corpus counts
back, so a word of all documents costs one entry per block.  Words are named by
64-bit hashes (58 bits of hash, six of letter class).

Null or empty text: one token, the end.  Null ``doc_id``: its text for the split
is empty, which is a training document.  Repeated rows are scored each and
counted each.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (LOWER, U64, Words, asking_blocks, block_of, dealt_by, documents, mix, pieces, text_bytes, text_size,
                     written)
from .substring_dedup import from_planes, planes

BLOCK_BYTES = 4 << 20
CLASSES = 16
#: Cells with a word of their own, and cells that others share by their letters.
TOP_CELLS, LETTER_CELLS = 192, 64
#: Rows of weights for each kind of feature and each factor.
ROWS = 4096
KINDS = 3
ROUNDS = 2
RATE = 0.15
STEP_TOKENS = 16384
#: Bytes of text whose tokens make whole steps, the last one shorter.
TRAIN_BYTES = 2 << 20
END = (mix(np.array([0x656E64], U64))[0] & ~U64(63)) | U64(1)
START = mix(np.array([0x7374], U64))[0]
HELD_OUT_MOD, HELD_OUT = 7, 2


def _tokens(batch) -> tuple[np.ndarray, np.ndarray]:
    """Token names of all rows, each row closed by the end, and the rows' bounds;
    hashed a slice at a time, which bounds the memory of a block's task."""
    parts = [_tokens_of(part) for part in pieces(batch)]
    sizes = np.concatenate([np.zeros(0, np.int64), *[np.diff(bounds) for _, bounds in parts]])
    return np.concatenate([np.zeros(0, U64), *[names for names, _ in parts]]), np.concatenate([[0], np.cumsum(sizes)])


def _tokens_of(batch) -> tuple[np.ndarray, np.ndarray]:
    words = Words(*text_bytes(batch.column("text")))
    data, n = words.data, len(words.starts)
    last = LOWER[data[words.ends - 1]].astype(U64) if n else np.zeros(0, U64)
    second = np.where(words.ends - words.starts > 1, LOWER[data[words.ends - 2]], 0).astype(U64) if n else last
    letters = mix(second * U64(256) + last + U64(1)) & U64(63)
    names = (words.hashes(LOWER) & ~U64(63)) | letters
    return np.insert(names, words.first[1:], END), words.first + np.arange(len(words.first))


def held_out(key: str = "doc_id"):
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % HELD_OUT_MOD == HELD_OUT


# --------------------------------------------------------------------------- counts

def _ranges(names: np.ndarray, buckets: int) -> np.ndarray:
    bucket = ((names >> U64(32)) * U64(buckets)) >> U64(32)
    return np.searchsorted(bucket, np.arange(buckets + 1, dtype=U64))


def _send(buckets: int):
    def send(table: pa.Table) -> pa.Table:
        names, bounds = _tokens(table)
        training = np.repeat(~table["held_out"].to_numpy(), np.diff(bounds))
        distinct, entry = np.unique(names, return_inverse=True)
        count = np.bincount(entry, training, len(distinct)).astype(np.int64)
        cut = _ranges(distinct, buckets)
        sent = [b for b in range(buckets) if cut[b] < cut[b + 1]]
        return pa.table({
            "bucket": pa.array(sent, pa.int32()),
            "block": pa.array([table["block"][0].as_py()] * len(sent), pa.int32()),
            "names": pa.array([planes(np.diff(distinct[cut[b]:cut[b + 1]], prepend=U64(0))) for b in sent], pa.binary()),
            "counts": pa.array([planes(count[cut[b]:cut[b + 1]]) for b in sent], pa.binary())})
    return send


def _total(table: pa.Table) -> pa.Table:
    """Corpus counts for one range of names; the first row also has its summary."""
    names = [np.cumsum(from_planes(x.as_py(), U64), dtype=U64) for x in table["names"]]
    size = np.cumsum([0] + [len(x) for x in names])
    distinct, entry = np.unique(np.concatenate(names), return_inverse=True)
    count = np.bincount(entry, np.concatenate([from_planes(x.as_py(), np.int64) for x in table["counts"]]),
                        len(distinct)).astype(np.int64)
    known, letters = count > 0, (distinct & U64(63)).astype(int)
    top = np.argsort(-count, kind="stable")[:TOP_CELLS]
    n = table.num_rows
    first = lambda x, kind: pa.array([x] + [[]] * (n - 1), kind)
    return pa.table({
        "block": table["block"], "bucket": table["bucket"],
        "counts": pa.array([planes(count[entry[a:b]]) for a, b in zip(size, size[1:])], pa.binary()),
        "types": first(np.bincount(letters, known, 64).astype(np.int64).tolist(), pa.list_(pa.int64())),
        "tokens": first(np.bincount(letters, count, 64).astype(np.int64).tolist(), pa.list_(pa.int64())),
        "top": first(distinct[top].view(np.int64).tolist(), pa.list_(pa.int64())),
        "top_counts": first(count[top].tolist(), pa.list_(pa.int64()))})


class Vocabulary:
    """Cells and their sizes: what every task needs, whatever the corpus's size."""

    def __init__(self, counted: DataFrame):
        sums = {r["place"]: r for r in counted.select(F.posexplode(F.arrays_zip("types", "tokens")).alias("place", "x"))
                .groupBy("place").agg(F.sum("x.types").alias("types"), F.sum("x.tokens").alias("tokens")).collect()}
        types = np.array([sums[i]["types"] if i in sums else 0 for i in range(64)], np.int64)
        tokens = np.array([sums[i]["tokens"] if i in sums else 0 for i in range(64)], np.int64)
        self.types, self.tokens = int(types.sum()), int(tokens.sum())
        top = (counted.select(F.explode(F.arrays_zip("top", "top_counts")).alias("x")).select("x.top", "x.top_counts")
               .where("top_counts > 0").orderBy(F.desc("top_counts"), "top").limit(TOP_CELLS).collect())
        count = {r["top"] % 2**64: r["top_counts"] for r in top}
        end = int(END)
        if end not in count:
            count = {end: 0} | dict(list(count.items())[:TOP_CELLS - 1])
        # frequent words of alternating classes, so that classes weigh about the same
        names = np.array(list(count), U64)
        own = np.array([count[int(x)] for x in names], np.int64)
        order = np.argsort(names)
        self.names, cell = names[order], np.arange(len(names))[order]
        self.cells = cell
        letter = (self.names & U64(63)).astype(int)
        np.subtract.at(tokens, letter, own[order])
        np.subtract.at(types, letter, (own[order] > 0).astype(np.int64))
        per_cell = np.zeros(TOP_CELLS + LETTER_CELLS, np.int64)
        per_cell[cell] = own[order]
        per_cell[TOP_CELLS:] = tokens
        self.share = np.zeros(TOP_CELLS + LETTER_CELLS)
        self.share[TOP_CELLS:] = np.log10(tokens + types + 1)
        spread = np.arange(TOP_CELLS + LETTER_CELLS)
        self.class_of, self.inner = spread % CLASSES, spread // CLASSES
        self.bias = np.zeros((CLASSES, CLASSES), np.float32)
        self.bias[self.class_of, self.inner] = np.log(per_cell + 1.0)

    def cell(self, names: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[place] == names, self.cells[place], TOP_CELLS + (names & U64(63)).astype(int))


# --------------------------------------------------------------------------- model

def _features(names: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hashes of each token's history: word before, two before, skipping one."""
    one, two = np.empty_like(names), np.empty_like(names)
    one[1:], two[2:] = names[:-1], names[:-2]
    starts = bounds[:-1]
    one[starts] = START
    two[:2] = START
    two[starts] = START
    second = starts + 1
    two[second[second < bounds[1:]]] = START
    return np.stack([mix(one + U64(1)), mix(one * U64(3) + two * U64(5) + U64(2)), mix(two + U64(3))])


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    return logits


class Model:
    """Weights of both factors: 2 * KINDS * ROWS rows of 16."""

    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray | None = None):
        self.vocabulary = vocabulary
        self.weights = np.zeros((2 * KINDS * ROWS, CLASSES), np.float32) if weights is None else weights

    def _rows(self, features: np.ndarray, token_class: np.ndarray) -> tuple[list, list]:
        base = [kind * ROWS for kind in range(2 * KINDS)]
        first = [(f & U64(ROWS - 1)).astype(np.int64) + base[k] for k, f in enumerate(features)]
        turned = mix(token_class.astype(U64) + U64(17))
        second = [((((f ^ turned) * U64(0x9E3779B97F4A7C15)) >> U64(40)) & U64(ROWS - 1)).astype(np.int64)
                  + base[KINDS + k] for k, f in enumerate(features)]
        return first, second

    def _factors(self, features, cell):
        v = self.vocabulary
        token_class, inner = v.class_of[cell], v.inner[cell]
        first, second = self._rows(features, token_class)
        top = np.log(np.exp(v.bias).sum(1))
        a = np.broadcast_to(top, (len(cell), CLASSES)).copy()
        b = v.bias[token_class]
        for rows in first:
            a += self.weights[rows]
        for rows in second:
            b += self.weights[rows]
        return (first, _softmax(a), token_class), (second, _softmax(b), inner)

    def log10(self, names: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log10 of P(cell | history) of each token."""
        features, cell = _features(names, bounds), self.vocabulary.cell(names)
        out = np.empty(len(names))
        for begin in range(0, len(names), STEP_TOKENS):
            part = slice(begin, begin + STEP_TOKENS)
            n = np.arange(len(cell[part]))
            (_, a, x), (_, b, y) = self._factors(features[:, part], cell[part])
            out[part] = np.log10(np.maximum(a[n, x], 1e-30)) + np.log10(np.maximum(b[n, y], 1e-30))
        return out

    def steps(self, names: np.ndarray, bounds: np.ndarray, squares: np.ndarray, seen: np.ndarray) -> None:
        """AdaGrad steps over the tokens, in place."""
        features, cell = _features(names, bounds), self.vocabulary.cell(names)
        for begin in range(0, len(names), STEP_TOKENS):
            part = slice(begin, begin + STEP_TOKENS)
            n = np.arange(len(cell[part]))
            for rows_of_kinds, p, gold in self._factors(features[:, part], cell[part]):
                p[n, gold] -= 1
                for rows in rows_of_kinds:
                    order = np.argsort(rows, kind="stable")
                    sorted_rows = rows[order]
                    edge = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
                    gradient, row = np.add.reduceat(p[order], edge), sorted_rows[edge]
                    squares[row] += gradient * gradient
                    self.weights[row] -= RATE * gradient / np.sqrt(squares[row] + 1)
                    seen[row] += np.diff(np.append(edge, len(rows)))


def train(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Model:
    """Distributed gradient updates over all training documents of ``docs``."""
    model = Model(vocabulary)
    columns = [f"w{i}" for i in range(CLASSES)]
    schema = "row int, seen double, " + ", ".join(f"{c} float" for c in columns)
    texts = docs.where(~held_out()).select("text", F.pmod(F.xxhash64("doc_id"), F.lit(rounds)).alias("round"))
    for number in range(rounds):
        before = model.weights

        def run(batches, before=before):
            local = Model(vocabulary, before.copy())
            squares, seen = np.zeros_like(before), np.zeros(len(before))
            for whole in batches:
                for batch in pieces(whole, most=TRAIN_BYTES):
                    names, bounds = _tokens(batch)
                    if len(names):
                        local.steps(names, bounds, squares, seen)
            row = np.flatnonzero(seen)
            change = (local.weights[row] - before[row]) * seen[row, None].astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row, pa.int32()), pa.array(seen[row])]
                + [pa.array(np.ascontiguousarray(change[:, i]), pa.float32()) for i in range(CLASSES)],
                ["row", "seen", *columns])
        changes = (texts.where(F.col("round") == number).select("text").mapInArrow(run, schema).groupBy("row")
                   .agg(F.sum("seen").alias("seen"), *[F.sum(c).alias(c) for c in columns]).toPandas())
        weights = before.copy()
        if len(changes):
            weights[changes["row"].to_numpy()] += (
                changes[columns].to_numpy() / changes[["seen"]].to_numpy()).astype(np.float32)
        model = Model(vocabulary, weights)
    return model


def _score(buckets: int, model: Model):
    def score(table: pa.Table, counted: pa.Table) -> pa.Table:
        names, bounds = _tokens(table)
        distinct, entry = np.unique(names, return_inverse=True)
        cut, count = _ranges(distinct, buckets), np.zeros(len(distinct), np.int64)
        for bucket, blob in zip(counted["bucket"].to_pylist(), counted["counts"].to_pylist()):
            count[cut[bucket]:cut[bucket + 1]] = from_planes(blob, np.int64)
        v = model.vocabulary
        plain = np.log10(count + 1.0)[entry]
        cell = v.cell(distinct)
        within = np.where(cell < TOP_CELLS, 0.0, np.log10(count + 1.0) - v.share[cell])[entry]
        sums = lambda x: np.add.reduceat(x, bounds[:-1]) if len(bounds) > 1 else np.zeros(0)
        size = np.diff(bounds)
        return pa.table({
            "doc_id": table["doc_id"], "held_out": table["held_out"],
            "n_tokens": pa.array(size, pa.int64()),
            "n_known": pa.array(sums((count > 0)[entry].astype(np.int64)), pa.int64()),
            "train_tokens": pa.array(np.full(len(size), v.tokens), pa.int64()),
            "base_score": pa.array(sums(plain) - size * np.log10(v.tokens + v.types + 1)),
            "score": pa.array(sums(model.log10(names, bounds) + within))})
    return score


def score_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES, rounds: int = ROUNDS) -> DataFrame:
    """Trains on the training documents and scores all: a row for each document
    with its add-one unigram ``base_score`` and the model's ``score``."""
    blocks = asking_blocks(text_size(docs), block_bytes)
    # the text counts too: rows of one id, or of none, go to many blocks
    dealt = dealt_by(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"),
                                 block_of(blocks, "doc_id", "text").alias("block")), "block", blocks)
    sent = dealt.groupBy("block").applyInArrow(_send(blocks), "bucket int, block int, names binary, counts binary")
    counted = written(dealt_by(sent, "bucket", blocks).groupBy("bucket").applyInArrow(
        _total, "block int, bucket int, counts binary, types array<long>, tokens array<long>, top array<long>, "
                "top_counts array<long>"), "language-model-counts")
    model = train(docs, Vocabulary(counted), rounds)
    answers = counted.select("block", "bucket", "counts")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score(blocks, model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                               "base_score double, score double")


def op8_language_model(spark, sf_dir):
    return score_documents(documents(spark, sf_dir))
