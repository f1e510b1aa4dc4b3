"""Operator 12: periodic runs of words, found by recursive frequency splitting.

A run is a maximal stretch of words with smallest period q and a length of at
least ``max(MIN_LENGTH, MIN_TURNS * q)``.  Each word of a run occurs at least
``MIN_TURNS`` times in it, so a word that is rarer than that within its segment
belongs to no run: it splits the segment.  Segments (whole documents at first)
are split until nothing changes; those shorter than ``MIN_LENGTH`` go.

The segments that survive are scanned by lag.  For a lag q only the places
0, q, 2q, ... are tested: a run holds two equal neighbouring blocks of q words
that begin at such a place, so a segment of m words takes m/1 + m/2 + m/3 + ...
tests and never m * m.  Blocks whose word sequence is itself a repetition belong
to a smaller period.  What is left is extended to both sides by bisection over
prefix hashes.  Words and blocks are compared by 64-bit hashes, and runs are
compared word by word (ids of words) before they are returned.

One pass without a shuffle; documents are independent, so hot keys, ties and
repeated rows change nothing.  Null text: no words, no runs.  Null ``doc_id``:
a document like any other.  An empty table gives no rows.  Other columns are
ignored, whatever their names.  Texts are whole, whatever their length: memory
is about 100 bytes a word of the longest one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, _tables, documents, pieces, text_bytes
from .substring_dedup import _kept_text

MIN_LENGTH = 6
MIN_TURNS = 4
#: Rounds of splitting.  Segments that still change then are scanned as they are,
#: which finds the same runs: splitting only saves work.
MOST_ROUNDS = 64
#: Places tested at once.
_STEP = 1 << 21

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def split_by_frequency(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the segments that may hold runs.  ``word`` are word ids
    from 0, ``first`` the bounds of the documents in them."""
    kinds = int(word.max()) + 1 if len(word) else 1
    place = np.arange(len(word))
    segment = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begins, ends = [], []
    for _ in range(MOST_ROUNDS):
        if not len(place):
            break
        _, of, count = np.unique(segment * kinds + word[place], return_inverse=True, return_counts=True)
        frequent = count[of] >= MIN_TURNS
        total = np.bincount(segment)
        kept = np.bincount(segment[frequent], minlength=len(total))
        stable = (kept == total)[segment]
        for part, final in ((stable, True), (frequent & ~stable, False)):
            at, seg = place[part], segment[part]
            if not len(at):
                begin = end = at
            else:
                new = np.flatnonzero((np.diff(at) > 1) | (np.diff(seg) > 0)) + 1
                begin, end = np.concatenate([[0], new]), np.concatenate([new, [len(at)]])
            long = end - begin >= MIN_LENGTH
            begin, end = begin[long], end[long]
            if final:
                begins.append(at[begin])
                ends.append(at[end - 1] + 1 if len(end) else end)
            else:
                inside = np.zeros(len(at) + 1, np.int64)
                inside[begin] += 1
                np.add.at(inside, end, -1)
                chosen = np.cumsum(inside)[:-1] > 0
                place = at[chosen]
                segment = np.repeat(np.arange(len(begin)), end - begin)
    else:
        if len(place):
            new = np.flatnonzero(np.diff(segment) > 0) + 1
            begins.append(place[np.concatenate([[0], new])])
            ends.append(place[np.concatenate([new - 1, [len(place) - 1]])] + 1)
    if not begins:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins, ends = np.concatenate(begins), np.concatenate(ends)
    order = np.argsort(begins)
    return begins[order], ends[order]


class _Hashes:
    """Hashes of any stretch of words, for stretches of equal length."""

    def __init__(self, word: np.ndarray):
        power, self.inverse = _tables(len(word) + 1)
        self.sums = np.zeros(len(word) + 1, U64)
        np.cumsum((word.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(1)) * power[:len(word)], out=self.sums[1:])

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        one = (self.sums[a + size] - self.sums[a]) * self.inverse[a]
        return one == (self.sums[b + size] - self.sums[b]) * self.inverse[b]

    def reach(self, a, b, most, side: int) -> np.ndarray:
        """How many words from ``a`` and ``b`` on (side 1), or before them (-1), agree; ``most`` at most."""
        n = np.zeros(len(a), np.int64)
        step = 1 << max(0, int(most.max()).bit_length() - 1) if len(a) else 0
        while step:
            can = np.flatnonzero(n + step <= most)
            x, y = (a[can] + n[can], b[can] + n[can]) if side > 0 else (a[can] - n[can] - step, b[can] - n[can] - step)
            good = can[self.same(x, y, np.full(len(can), step))]
            n[good] += step
            step >>= 1
        return n


def _smallest_primes(n: int) -> np.ndarray:
    least = np.arange(n + 1)
    for i in range(2, int(n ** 0.5) + 1):
        if least[i] == i:
            part = least[i * i::i]
            part[part == np.arange(i * i, n + 1, i)] = i
    return least


def lag_scan(word: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Runs (start, end, period) within the segments, by start and period."""
    lags = (ends - begins) // MIN_TURNS
    if not len(begins) or not lags.max():
        return np.zeros((0, 3), np.int64)
    hashes, least = _Hashes(word), _smallest_primes(int(lags.max()))
    found = []
    segments = np.cumsum(lags)  # pairs of a segment and a lag, numbered through
    pair = 0
    while pair < segments[-1]:
        upto = min(int(segments[-1]), pair + _STEP)
        number = np.arange(pair, upto)
        of = np.searchsorted(segments, number, side="right")
        q = number - (segments[of] - lags[of]) + 1
        tests = (ends[of] - begins[of]) // q - 1
        total = np.cumsum(tests)
        fits = max(1, int(np.searchsorted(total, _STEP, side="right")))
        of, q, tests, pair = of[:fits], q[:fits], tests[:fits], pair + min(fits, len(of))
        which = np.repeat(np.arange(len(q)), tests)
        turn = np.arange(len(which)) - np.repeat(np.cumsum(tests) - tests, tests)
        at, lag, of = begins[of][which] + turn * q[which], q[which], of[which]
        hit = np.flatnonzero(word[at] == word[at + lag])
        hit = hit[hashes.same(at[hit], at[hit] + lag[hit], lag[hit])]
        rest = lag[hit].copy()
        while len(hit) and rest.max() > 1:
            prime = least[rest]
            part = np.where(prime > 1, lag[hit] // np.maximum(prime, 1), lag[hit])
            power = (prime > 1) & hashes.same(at[hit], at[hit] + part, lag[hit] - part)
            hit, rest, prime = hit[~power], rest[~power], prime[~power]
            while True:
                more = (prime > 1) & (rest % np.maximum(prime, 1) == 0)
                if not more.any():
                    break
                rest[more] //= prime[more]
        at, lag, of = at[hit], lag[hit], of[hit]
        right = hashes.reach(at, at + lag, ends[of] - at - lag, 1)
        left = hashes.reach(at, at + lag, at - begins[of], -1)
        runs = np.stack([at - left, at + lag + right, lag], 1)
        size = runs[:, 1] - runs[:, 0]
        found.append(np.unique(runs[(size >= MIN_LENGTH) & (size >= MIN_TURNS * lag)], axis=0))
    runs = np.unique(np.concatenate(found), axis=0)
    for start, end, q in runs:
        if not np.array_equal(word[start:end - q], word[start + q:end]):
            raise RuntimeError("two word sequences share a 64-bit hash")
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    words = Words(*text_bytes(batch.column("text")))
    word = np.unique(words.hashes(), return_inverse=True)[1]
    runs = lag_scan(word, *split_by_frequency(word, words.first))
    depth = np.zeros(len(word) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 1], -1)
    document = np.searchsorted(words.first, runs[:, 0], side="right") - 1
    table = pa.StructArray.from_arrays(
        [pa.array(x, pa.int64()) for x in (runs[:, 0] - words.first[document], runs[:, 1] - runs[:, 0], runs[:, 2])],
        ["start", "length", "period"])
    offsets = np.searchsorted(document, np.arange(batch.num_rows + 1))
    return pa.RecordBatch.from_arrays([
        batch.column("doc_id"), pa.array(words.counts, pa.int64()),
        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), table),
        _kept_text(words, np.cumsum(depth)[:-1] > 0).cast(pa.string()),
    ], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """A row for each document: ``n_words``, its ``runs`` (start, length and period
    in words, by start and period) and ``collapsed``, its words without those that
    a run repeats (all but the run's first period), joined by one space."""
    def rows(batches):
        for batch in batches:
            for part in pieces(batch):
                yield _rows(part)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(rows, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first of equal ones."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")

    def better(best, run):
        more = best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
        return F.when(more, run).otherwise(best)
    return F.reduce(runs, none, better)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The query's texts: a tenth of the documents repeat a stretch of their words."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    listed = docs.select("doc_id", "text", F.when(h % 10 == 0, F.filter(
        F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("words"), g.alias("g"))
    n = F.size("words")
    a = (F.col("g") % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    turns = F.floor((n - a) / p).cast("int") + 1
    repeated = F.slice(F.concat(F.slice("words", F.lit(1), a),
                                F.flatten(F.array_repeat(F.slice("words", a + 1, p), turns))), F.lit(1), n)
    return listed.select("doc_id", F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir):
    found = periodic_runs(with_planted_runs(documents(spark, sf_dir)))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    every = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), strongest(F.col("runs")).alias("best"),
                       F.sha2(every, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                      F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
                      "runs_sha256", "collapsed_sha256")
