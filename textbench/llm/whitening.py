"""Operator 11: embedding whitening by a weighted multiplicity covariance.

Entries c become integers floor(SCALE * c) + SHIFT.  Identical integer vectors
are grouped; each distinct one enters the fit once, with its number of copies as
weight (or one, ``by_copies=False``).  The covariance is a weighted GEMM of the
centred distinct vectors, a partial one in each task, added up by rows of the
matrix.  Each distinct vector is whitened once and joined back to its rows.

Sums are exact integers, and so are n * x - S and ``deviation``; a deviation
beyond a 64-bit integer is null.  Components are numbered by falling eigenvalue,
the entry of greatest size in each is positive.  A component without variance
(rank-deficient vectors, one distinct vector) has ``explained`` 0 and null
``whitened`` values; ``explained`` is null where no component has variance.
``identity_error`` is measured on the whitened vectors in a pass of its own, over
the components with variance (null if there is none).

Skew: a vector with over 1 / HOT of all rows is joined by broadcast (there are
fewer than HOT of those), all others by a shuffle, in which a key then has at
most that share of the rows.  The driver holds one matrix of dimension x dimension.

Null vectors and vectors with null or non-finite entries, or entries of at least
2**47 in size, have no rows.  Vectors of other lengths are a fit of their own,
each over the vectors of its length; empty ones have no components.  Rows with
null or repeated ids are rows like any other.  An empty table gives no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, written

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
HOT = 1024
#: Eigenvalues are taken by Jacobi rotations, exact for small ones too, beyond this ratio of the largest to the smallest.
_SPREAD = 1e9
_LARGEST = 2 ** 47
#: Entries that a task converts at once.
ENTRIES = 1 << 20


# --------------------------------------------------------------------------- integer vectors as keys

def _keys(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Rows with a usable vector, and their keys: a width and the entries
    floor(SCALE * c) as integers of that many bytes."""
    if not pa.types.is_list(column.type) and not pa.types.is_large_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    valid = ~np.asarray(column.is_null())
    sizes = np.where(valid, np.diff(np.asarray(column.offsets)), 0).astype(np.int64)
    values = column.flatten()
    if not len(values):  # nothing but empty and null vectors
        values = pa.array([], pa.float64())
    entry = values.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False).astype(np.float64)
    good = np.isfinite(entry) & (np.abs(entry) < _LARGEST)
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~good)])
    rows = np.flatnonzero(valid & (bad[ends] == bad[ends - sizes]))
    floor = np.floor(np.where(good, entry, 0) * SCALE).astype(np.int64)
    order, keys = [], []
    for size in np.unique(sizes[rows]):
        at = rows[sizes[rows] == size]
        matrix = floor[(ends - sizes)[at][:, None] + np.arange(size)]
        most = np.maximum(matrix.max(1, initial=0), -matrix.min(1, initial=0) - 1)
        width = np.array([1, 2, 4, 8])[np.searchsorted([0x80, 0x8000, 0x80000000], most, side="right")]
        for w in np.unique(width):
            some = matrix[width == w].astype(f"<i{w}")
            raw = np.empty((len(some), 1 + size * w), np.uint8)
            raw[:, 0] = w
            raw[:, 1:] = np.ascontiguousarray(some).view(np.uint8).reshape(len(some), -1)
            offsets = np.arange(len(some) + 1, dtype=np.int32) * raw.shape[1]
            keys.append(pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]))
            order.append(at[width == w])
    if not keys:
        return rows, pa.array([], pa.binary())
    return np.concatenate(order), pa.concat_arrays(keys)


def _vectors(keys: pa.Array):
    """The integer vectors of keys: length, which rows and their matrix, at most ENTRIES (or one row) at once."""
    offsets = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset:keys.offset + len(keys) + 1].astype(np.int64)
    data = np.frombuffer(keys.buffers()[2], np.uint8)
    size, width = np.diff(offsets) - 1, data[offsets[:-1]].astype(np.int64)
    length = size // width
    for n in np.unique(length):
        step = max(1, ENTRIES // max(1, int(n)))
        for w in np.unique(width[length == n]):
            every = np.flatnonzero((length == n) & (width == w))
            for begin in range(0, len(every), step):
                at = every[begin:begin + step]
                raw = data[offsets[at][:, None] + 1 + np.arange(n * w)]
                yield int(n), at, np.ascontiguousarray(raw).view(f"<i{w}").reshape(len(at), n).astype(np.int64)


def integer_vectors(vectors: DataFrame, row_id: str, column: str) -> DataFrame:
    def rows(batches):
        for batch in batches:
            entries = len(batch.column("vector").flatten()) if batch.num_rows else 0
            step = max(1, batch.num_rows * ENTRIES // max(1, entries, ENTRIES))
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                at, keys = _keys(part.column("vector"))
                yield pa.RecordBatch.from_arrays([part.column("row_id").take(pa.array(at)), keys], ["row_id", "key"])
    chosen = vectors.select(F.col(row_id).alias("row_id"), F.col(column).alias("vector"))
    kind = chosen.schema["row_id"].dataType.simpleString()
    return chosen.mapInArrow(rows, f"row_id {kind}, key binary")


# --------------------------------------------------------------------------- fit

def _weights(batch: pa.RecordBatch, by_copies: bool) -> np.ndarray:
    return batch.column("copies").to_numpy() if by_copies else np.ones(batch.num_rows, np.int64)


def _totals(distinct: DataFrame, by_copies: bool) -> dict[int, tuple[int, list[int], int]]:
    """By length: the number of vectors, the sum of each entry, the largest size of an entry."""
    def sums(batches):
        total, largest = {}, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            weight = _weights(batch, by_copies)
            for length, at, x in _vectors(batch.column("key")):
                w, most = weight[at], int(np.abs(x).max(initial=0))
                exact = (most + 1) * int(w.sum()) < 2 ** 62
                s = w @ x if exact else w.astype(object) @ x.astype(object)
                new = [int(w.sum()), *map(int, s)]
                total[length] = [a + b for a, b in zip(total.get(length, [0] * len(new)), new)]
                largest[length] = max(most, largest.get(length, 0))
        for length, row in total.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([length] * len(row), pa.int32()), pa.array(range(len(row)), pa.int32()),
                pa.array([Decimal(x) for x in row], pa.decimal128(38, 0)),
                pa.array([largest[length]] * len(row), pa.int64())], ["length", "entry", "total", "largest"])
    rows = distinct.mapInArrow(sums, "length int, entry int, total decimal(38,0), largest long") \
        .groupBy("length", "entry").agg(F.sum("total").alias("total"), F.max("largest").alias("largest")).collect()
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r["length"], r["entry"])):
        out.setdefault(r["length"], []).append((int(r["total"]), r["largest"]))
    return {length: (x[0][0], [t for t, _ in x[1:]], x[0][1]) for length, x in out.items()}


def _deviations(x: np.ndarray, n: int, total: list[int], largest: int) -> np.ndarray:
    """n * x - S, exact."""
    if 2 * n * (largest + 1) < 2 ** 62:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def _added(parts: DataFrame) -> dict[int, np.ndarray]:
    """Matrices by length, added up from the rows of the tasks' partial matrices."""
    def add(table: pa.Table) -> pa.Table:
        rows = np.array(table["values"].to_pylist())
        # in order of size: the sum does not depend on the order of arrival
        total = np.sort(rows, axis=0).sum(axis=0)
        return pa.table({"length": table["length"][:1], "entry": table["entry"][:1],
                         "values": pa.array([total.tolist()], pa.list_(pa.float64()))})
    kind = "length int, entry int, values array<double>"
    rows = parts.groupBy("length", "entry").applyInArrow(add, kind).collect()
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r["length"], r["entry"])):
        out.setdefault(r["length"], []).append(r["values"])
    return {length: np.array(x) for length, x in out.items()}


def _matrix_rows(matrices: dict[int, np.ndarray]):
    for length, m in matrices.items():
        yield pa.RecordBatch.from_arrays([
            pa.array([length] * len(m), pa.int32()), pa.array(range(len(m)), pa.int32()),
            pa.array(m.tolist(), pa.list_(pa.float64()))], ["length", "entry", "values"])


def _covariance(distinct: DataFrame, totals, by_copies: bool) -> dict[int, np.ndarray]:
    def gemm(batches):
        sums: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            weight = _weights(batch, by_copies)
            for length, at, x in _vectors(batch.column("key")):
                n, total, largest = totals[length]
                centred = (_deviations(x, n, total, largest) / n).astype(np.float64)
                sums[length] = sums.get(length, 0) + (centred * weight[at][:, None]).T @ centred
        yield from _matrix_rows(sums)
    found = _added(distinct.mapInArrow(gemm, "length int, entry int, values array<double>"))
    return {length: m / totals[length][0] for length, m in found.items()}


def _jacobi(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors by rotations, each eigenvalue to its own precision."""
    a, q = v.copy(), np.eye(len(v))
    for _ in range(60):
        turned = False
        for i in range(len(a) - 1):
            for j in range(i + 1, len(a)):
                if abs(a[i, j]) <= 1e-16 * np.sqrt(abs(a[i, i] * a[j, j])):
                    continue
                turned = True
                theta = (a[j, j] - a[i, i]) / (2 * a[i, j])
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(theta, 1))
                c = 1 / np.hypot(t, 1)
                s, shift = t * c, t * a[i, j]
                second = a[:, [i, j]].copy()
                a[:, i], a[:, j] = c * second[:, 0] - s * second[:, 1], s * second[:, 0] + c * second[:, 1]
                a[i], a[j] = a[:, i], a[:, j]
                a[i, i], a[j, j] = second[i, 0] - shift, second[j, 1] + shift
                a[i, j] = a[j, i] = 0
                q[:, [i, j]] = q[:, [i, j]] @ np.array([[c, s], [-s, c]])
        if not turned:
            break
    return np.diag(a).copy(), q


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit eigenvectors (columns), their eigenvalues and which have variance."""
    def usable(e):
        return e > 4 * len(v) * np.finfo(float).eps * max(e.max(initial=0), 0)
    e, q = np.linalg.eigh(v)
    real = e[usable(e)]
    if len(real) and real.max() > _SPREAD * real.min():
        e, q = _jacobi(v)
    order = np.argsort(-e, kind="stable")[:most]
    e, q = e[order], q[:, order]
    q = q * np.where(q[np.abs(q).argmax(0), np.arange(q.shape[1])] < 0, -1, 1) if q.size else q
    return q, e, usable(np.linalg.eigvalsh(v))[::-1][:len(e)] & (e > 0) if len(e) else usable(e)


def whiten(vectors: DataFrame, row_id: str = "vec_id", column: str = "embedding", most: int = COMPONENTS,
           by_copies: bool = True) -> DataFrame:
    """A row for each usable vector: ``row_id``, its ``length``, the number of
    vectors fitted ``n``, ``deviation``, ``whitened`` (an array, a value for each of
    up to ``most`` components), and, equal for all rows of a length, ``explained``
    and ``identity_error``."""
    spark = vectors.sparkSession
    rows = written(integer_vectors(vectors, row_id, column), "integer-vectors")
    distinct = written(rows.groupBy("key").agg(F.count("*").alias("copies")), "distinct-vectors")
    totals = _totals(distinct, by_copies)
    fits = {}
    for length, v in _covariance(distinct, totals, by_copies).items():
        q, e, usable = components(v, most)
        trace = np.trace(v)
        scale = np.where(usable, 1 / np.sqrt(np.where(usable, e, 1)), np.nan)
        fits[length] = q * scale, usable, [float(x) for x in np.maximum(e, 0) / trace] if trace > 0 else [None] * len(e)

    def project(batches):
        for batch in batches:
            for length, at, x in _vectors(batch.column("key")) if batch.num_rows else ():
                if length not in fits:
                    continue
                n, total, largest = totals[length]
                basis, usable, _ = fits[length]
                d = _deviations(x, n, total, largest)
                if length * int(np.abs(d).max(initial=0)) ** 2 < 2 ** 63:
                    deviation = pa.array((d.astype(np.int64) ** 2).sum(1), pa.int64())
                else:
                    big = [sum(int(a) ** 2 for a in row) for row in d]
                    deviation = pa.array([b if b < 2 ** 63 else None for b in big], pa.int64())
                z = (d / n).astype(np.float64) @ np.where(usable, basis, 0)
                values = pa.array(z.ravel(), mask=np.broadcast_to(~usable, z.shape).ravel())
                offsets = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
                yield pa.RecordBatch.from_arrays([
                    batch.column("key").take(pa.array(at)), batch.column("copies").take(pa.array(at)),
                    pa.array([length] * len(at), pa.int32()), deviation, pa.ListArray.from_arrays(offsets, values),
                ], ["key", "copies", "length", "deviation", "whitened"])

    whitened = written(distinct.mapInArrow(
        project, "key binary, copies long, length int, deviation long, whitened array<double>"), "whitened-vectors")

    def moments(batches):
        sums: dict = {}
        for batch in batches:
            length, weight = batch.column("length").to_numpy(), _weights(batch, by_copies)
            values = batch.column("whitened")
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                usable = fits[int(n)][1]
                flat = values.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
                z = np.column_stack([flat.reshape(len(at), len(usable))[:, usable], np.ones(len(at))])
                sums[int(n)] = sums.get(int(n), 0) + (z * weight[at][:, None]).T @ z
        yield from _matrix_rows(sums)

    kind = "length int, entry int, values array<double>"
    measured = {}
    for length, m in _added(whitened.mapInArrow(moments, kind)).items():
        m = m / totals[length][0]
        cov = m[:-1, :-1] - np.outer(m[-1, :-1], m[-1, :-1])
        measured[length] = float(np.abs(cov - np.eye(len(cov))).max()) if len(cov) else None
    summary = spark.createDataFrame(
        [(length, totals[length][0], fits[length][2], measured.get(length)) for length in fits],
        "length int, n long, explained array<double>, identity_error double")
    limit = (distinct.agg(F.sum("copies")).first()[0] or 0) // HOT
    hot = whitened.where(F.col("copies") > limit).drop("copies")
    rest = whitened.where(F.col("copies") <= limit).drop("copies")
    joined = rows.join(F.broadcast(hot), "key").unionByName(
        rows.join(F.broadcast(hot.select("key")), "key", "left_anti").join(rest, "key"))
    return joined.join(F.broadcast(summary), "length").select(
        "row_id", "length", "n", "deviation", "whitened", "explained", "identity_error")


def op11_whitening(spark, sf_dir):
    out = whiten(documents(spark, sf_dir, "embeddings"))
    return out.select(F.col("row_id").alias("vec_id"), "n", "deviation", "explained", "identity_error",
                      F.posexplode("whitened").alias("place", "whitened")) \
        .select("vec_id", (F.col("place") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
                F.col("explained")[F.col("place")].alias("explained"), "identity_error")
