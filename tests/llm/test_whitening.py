"""Operator 11 against numpy on the expanded vectors, and its edge cases."""

import math

import numpy as np
import pytest

from textbench.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int"


def integers(vector):
    if vector is None or any(c is None or not math.isfinite(c) for c in vector):
        return None
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vector]


def brute(rows, most=32):
    """Whole fit in numpy over the expanded list of vectors."""
    kept = [(i, x) for i, v in rows if (x := integers(v)) is not None]
    x = np.array([v for _, v in kept], object)
    n, total = len(x), x.sum(0)
    d = n * x - total
    centred = (d / n).astype(float)
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:most], q[:, ::-1][:, :most]
    z = centred @ q / np.sqrt(e)
    return [i for i, _ in kept], n, (d ** 2).sum(1), z, e / np.trace(v)


def vectors(n, d, seed, hot=0):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, d)) * np.linspace(2, .2, d) + r.normal(size=d)
    base[: hot] = base[0]
    return [(i, [float(c) for c in row]) for i, row in enumerate(base.astype(np.float32))]


def _check(got, rows, most=32):
    ids, n, deviation, z, explained = brute(rows, most)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert sorted(by) == sorted(ids)
    k = z.shape[1]
    table = np.array([[by[i][c + 1]["whitened"] for c in range(k)] for i in ids])
    sign = np.sign((table * z).sum(0))
    assert np.allclose(table * sign, z, atol=1e-7)
    for place, i in enumerate(ids):
        assert set(by[i]) == set(range(1, k + 1))
        assert all(by[i][c + 1]["deviation"] == deviation[place] and by[i][c + 1]["n"] == n for c in range(k))
    first = by[ids[0]]
    assert np.allclose([first[c + 1]["explained"] for c in range(k)], explained, rtol=1e-8)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def _query(spark, rows, path, partitions=3):
    spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(partitions) \
        .write.mode("overwrite").parquet(f"{path}/embeddings.parquet")
    return W.op11_whitening(spark, str(path)).collect()


@pytest.mark.parametrize("n,d,hot", [(300, 40, 100), (60, 5, 0), (40, 33, 0)])
def test_query_against_numpy(spark, tmp_path, n, d, hot):
    rows = vectors(n, d, n + d, hot)
    rows += [(1000, None), (1001, [None] * d), (1002, [float("nan")] + [0.0] * (d - 1)),
             (1003, [float("-inf")] + [0.0] * (d - 1)), (1004, rows[3][1])]
    _check(_query(spark, rows, tmp_path), rows)


def test_result_is_the_same_over_other_partitions(spark, tmp_path):
    rows = vectors(200, 12, 8, 70)
    a = {(r["vec_id"], r["component"]): r["whitened"] for r in _query(spark, rows, tmp_path / "a", 1)}
    b = {(r["vec_id"], r["component"]): r["whitened"] for r in _query(spark, rows, tmp_path / "b", 8)}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_wide_entries_and_great_spread(spark, tmp_path):
    r = np.random.default_rng(4)
    scale = np.array([3e7, 2e4, 30, 1, .2])
    rows = [(i, [float(c) for c in row]) for i, row in
            enumerate((r.normal(size=(200, 5)) * scale).astype(np.float32))]
    got = _query(spark, rows, tmp_path)
    ids, n, deviation, _, _ = brute(rows)
    assert {r["vec_id"]: r["deviation"] for r in got} == {
        i: int(x) if x < 2 ** 63 else None for i, x in zip(ids, deviation)}
    assert got[0]["identity_error"] < 1e-6


def test_jacobi_agrees_with_lapack():
    r = np.random.default_rng(2)
    a = r.normal(size=(20, 20))
    v = a @ a.T
    e, q = W._jacobi(v)
    assert np.allclose(np.sort(e), np.linalg.eigvalsh(v)) and np.allclose(q @ np.diag(e) @ q.T, v)


def test_weights_of_one(spark):
    rows = vectors(90, 6, 3, 50)
    out = W.whiten(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), by_copies=False).collect()
    distinct = list({tuple(integers(v)): (i, v) for i, v in reversed(rows)}.values())
    _, n, _, z, _ = brute(distinct)
    assert len(out) == 90 and {r["n"] for r in out} == {n}
    mine = {r["row_id"]: r["whitened"] for r in out}
    table = np.array([mine[i] for i, _ in distinct])
    assert np.allclose(np.abs(table), np.abs(z), atol=1e-7)


def test_components_without_variance(spark):
    flat = [(i, [float(i % 5), 2.0 * (i % 5), 7.0], 0) for i in range(30)]
    out = W.whiten(spark.createDataFrame(flat, SCHEMA)).collect()
    assert all(r["whitened"][0] is not None and r["whitened"][1:] == [None, None] for r in out)
    assert out[0]["explained"][0] == pytest.approx(1) and out[0]["identity_error"] < 1e-9
    one = W.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0)], SCHEMA)).collect()
    assert [tuple(r) for r in one] == [(1, 2, 1, 0, [None, None], [None, None], None)]


def test_ids_lengths_columns_and_empty_tables(spark):
    rows = [(None, [1.0, 2.0]), (4, [3.0, 1.0]), (4, [3.0, 1.0]), (5, [0.5, -9.0]), (6, [1.0]), (7, [2.5]), (8, []),
            (9, [1e38, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr(
        "*", "1 as key", "2 as copies", "3 as whitened", "4 as n", "5 as row_id", "6 as length", "7 as vector")
    out = W.whiten(d).collect()
    assert sorted((str(r["row_id"]), r["length"], r["n"]) for r in out) == [
        ("4", 2, 4), ("4", 2, 4), ("5", 2, 4), ("6", 1, 2), ("7", 1, 2), ("None", 2, 4)]
    assert W.whiten(d.limit(0)).count() == 0
    assert W.whiten(d.where("vec_id = 9")).count() == 0
    assert W.whiten(d.selectExpr("vec_id", "cast(null as array<double>) as embedding")).count() == 0
