"""Operator 12 against brute force, and its edge cases."""

import hashlib
import random
import zlib

import numpy as np

from tests.llm.conftest import make, words_of
from textbench.llm import periodic_runs as P


def brute(words):
    """Runs (start, length, period) by start and period: every lag over every word."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(6, 4 * q):
                smaller = [p for s, m, p in found if q % p == 0 and s <= i and s + m >= j + q]
                if not smaller:
                    found[i, size, q] = True
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a, = (g % n,)
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


def expected(doc_id, text):
    words = planted(doc_id, words_of(text))
    runs = brute(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def _scan(words):
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    word = np.array([ids[w] for w in words], np.int64)
    runs = P.lag_scan(word, *P.split_by_frequency(word, np.array([0, len(word)])))
    return [(int(s), int(e - s), int(q)) for s, e, q in runs]


def test_runs_against_brute_force_on_random_words():
    r = random.Random(5)
    for trial in range(400):
        letters = "abcdefgh"[:r.randint(1, 8)]
        words = []
        while len(words) < r.randint(5, 120):
            if r.random() < .5:
                block = [r.choice(letters) for _ in range(r.randint(1, 9))]
                words += block * r.randint(1, 7) + block[:r.randint(0, len(block))]
            else:
                words += [r.choice(letters + "xyzuvw") for _ in range(r.randint(0, 6))]
        assert _scan(words) == brute(words), words


def test_a_run_inside_the_period_of_another_run():
    words = (["a"] * 7 + ["b", "c"]) * 5
    assert _scan(words) == brute(words)
    assert {q for _, _, q in _scan(words)} == {1, 9}


def test_splitting_stops_and_bounds_work():
    # each round takes one more word away: the rounds are bounded, the result is not
    words = []
    for i in range(200):
        words += [f"w{i}", f"w{i + 1}", f"w{i + 2}", f"w{i + 3}"]
    assert _scan(words) == brute(words)
    many = np.arange(300_000) % 5
    runs = P.lag_scan(many, *P.split_by_frequency(many, np.array([0, len(many)])))
    assert runs.tolist() == [[0, 300_000, 5]]
    random_words = np.random.default_rng(1).integers(0, 3, 200_000)
    runs = P.lag_scan(random_words, *P.split_by_frequency(random_words, np.array([0, len(random_words)])))
    for s, e, q in runs:
        assert (random_words[s:e - q] == random_words[s + q:e]).all() and e - s >= max(6, 4 * q)


def test_segments_hold_only_frequent_words():
    words = "a b c d a b c d a b c d a b c d x a b c".split()
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    word = np.array([ids[w] for w in words])
    begins, ends = P.split_by_frequency(word, np.array([0, len(word)]))
    assert list(zip(begins, ends)) == [(0, 16)]


def test_query_against_brute_force(spark, docs, tmp_path):
    loops = ["x y z " * 5 + "tail", "go " * 6, "go " * 5, "a a a a a a b b b b b b", "é ß é ß é ß é ß é", "p q " * 9 + "r " * 9]
    extra = make(spark, loops * 12, range(1000, 1000 + 12 * len(loops)))
    small = docs.where("length(text) < 100000").unionByName(extra)
    small.write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in P.op12_periodic_runs(spark, str(tmp_path)).collect()}
    want = {expected(r["doc_id"], r["text"]) for r in small.collect()}
    assert got == want
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(1000, 1072))


def test_long_odd_and_empty_tables(spark, docs, odd, empty, tmp_path):
    long = P.periodic_runs(docs.where("length(text) > 100000")).first()
    assert [tuple(x) for x in long["runs"]] == [(0, 30000, 1)] and long["collapsed"] == "long"
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, P.op12_periodic_runs(spark, str(tmp_path)).collect()))
    assert len(got) == odd.count()
    nulls = P.periodic_runs(odd.where("text is null")).collect()
    assert nulls and all(r["n_words"] == 0 and r["runs"] == [] and r["collapsed"] == "" for r in nulls)
    assert P.periodic_runs(empty).count() == 0
    clash = odd.selectExpr("doc_id", "text", "1 as runs", "2 as collapsed", "3 as n_words", "4 as words", "5 as g")
    assert P.periodic_runs(P.with_planted_runs(clash)).count() == odd.count()
