"""Operator 2: quality by hierarchical empirical Bayes.

Each document gets evidence from a classifier, and each host (``source``) and
path (language section of a host) a posterior for its share of good documents.
Beta priors are fitted to the spread of the sites by moments, and sparse sites
shrink to them: a host towards the corpus, a path towards its host.  The
document's log odds and those of its path's posterior from the site's other
documents, relative to the corpus, add up to the document's posterior: its own
evidence counts once, and alone on its site it stands for itself.  The same is
done for ``toxic``.

The classifier adds the log odds of significant features (lower-case words
without outer punctuation, and ranges of counted properties of the text).  It is
fitted on up to ``MOST_LABELS`` labelled documents, those with the smallest
hashes of ``doc_id``: one half of these chooses and weighs the features, the other
half calibrates the evidence by a logistic curve.
All other figures are sums over all documents.

Labels outside 0 and 1 or null: not used.  Fewer than two classes: every
document has the classes' overall share.  Null or empty text: only the counted
properties.  Null ``source`` or ``lang``: a site of its own.  Null and repeated
``doc_id``: each row is scored by itself.  Empty tables give no rows.  Other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, Words, documents, mix, pieces, ragged, span_hashes, text_bytes, written

MOST_LABELS = 50_000
#: Significance that a feature's shares in the classes need, and how many features are used.
MIN_Z, MOST_FEATURES = 5.0, 20_000
#: Evidence is kept within these bounds: many rare words of one copied text say no more than that.
MOST_EVIDENCE = 50.0
SMOOTH = 0.5
TARGETS = ("quality", "toxic")

PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[list(b".,;:!?\"'()[]{}")] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>=+~^@_\\/")] = True


def _features(batch) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each row: hashes and the rows' numbers."""
    words = Words(*text_bytes(batch.column("text")))
    starts, ends = words.starts.copy(), words.ends.copy()
    for _ in range(3):
        starts += PUNCTUATION[words.data[starts]] & (ends - starts > 1) if len(starts) else 0
        ends -= PUNCTUATION[words.data[ends - 1]] & (ends - starts > 1) if len(ends) else 0
    word = span_hashes(LOWER[words.data], starts, ends)
    document, n = words.document(), len(words.counts)
    count = np.maximum(words.counts, 1)
    sums = lambda flags: np.bincount(document, flags, n)
    marked = np.concatenate([[0], np.cumsum(SYMBOL[words.data])])
    symbolic = (marked[words.ends] - marked[words.starts]) > 0
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (document[1:] == document[:-1])
    length = words.ends - words.starts
    pairs = np.unique(np.stack([document.astype(U64), word]), axis=1) if len(word) else np.zeros((2, 0), U64)
    distinct = np.bincount(pairs[0].astype(np.int64), minlength=n)
    figures = [np.ceil(10 * sums(symbolic) / count), np.ceil(10 * sums(again) / count),
               np.floor(np.log2(words.counts + 1)), np.floor(10 * distinct / count),
               np.minimum(np.floor(2 * sums(length) / count), 60)]
    made = [mix(f.astype(np.int64).astype(U64) + U64(1000 * (i + 1))) for i, f in enumerate(figures)]
    rows = np.concatenate([pairs[0].astype(np.int64), *[np.arange(n)] * len(made)])
    return np.concatenate([pairs[1], *made]), rows


def _sample(labels: DataFrame, target: str, most: int) -> DataFrame:
    return (labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull())
            .groupBy("doc_id").agg(F.max(target).cast("int").alias("label"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))


def _feature_rows(batches):
    """Labels, half and distinct features of each labelled row."""
    for whole in batches:
        for batch in pieces(whole):
            features, rows = _features(batch)
            order = np.argsort(rows, kind="stable")
            edge = np.searchsorted(rows[order], np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in (*TARGETS, "half")], ragged(edge, features[order].view(np.int64), pa.int64())],
                [*TARGETS, "half", "features"])


class Evidence:
    """Log odds of significant features for a target, and their calibration."""

    def __init__(self, feature, weight, prior, slope=1.0):
        order = np.argsort(feature)
        self.feature, self.weight = feature[order], weight[order]
        self.prior, self.slope = prior, slope

    def sums(self, features: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        if not len(self.feature):
            return np.zeros(n)
        place = np.minimum(np.searchsorted(self.feature, features), len(self.feature) - 1)
        hit = self.feature[place] == features
        return np.clip(np.bincount(rows[hit], self.weight[place[hit]], n), -MOST_EVIDENCE, MOST_EVIDENCE)

    def calibrate(self, evidence: np.ndarray, label: np.ndarray, count: np.ndarray) -> None:
        """A logistic curve of the evidence, its slope drawn towards one: Newton
        steps over the bins, halved until the (concave) likelihood grows."""
        def likelihood(a, b):
            odds = a * evidence + b
            return -np.sum(count * (np.logaddexp(0, odds) - label * odds)) - (a - 1) ** 2 / 2

        a, b = self.slope, self.prior
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a * evidence + b, -30, 30)))
            slack, w = count * (label - p), count * p * (1 - p)
            h = np.array([[np.sum(w * evidence**2) + 1, np.sum(w * evidence)],
                          [np.sum(w * evidence), np.sum(w) + 1e-6]])
            step = np.linalg.solve(h, [np.sum(slack * evidence) + 1 - a, np.sum(slack)])
            while np.abs(step).max() > 1e-9 and not likelihood(a + step[0], b + step[1]) > likelihood(a, b):
                step = step / 2
            if np.abs(step).max() <= 1e-9:
                break
            a, b = a + step[0], b + step[1]
        self.slope, self.prior = float(a), float(b)


def _apply(evidence: dict[str, Evidence]):
    def run(batches):
        for whole in batches:
            for batch in pieces(whole):
                features, rows = _features(batch)
                kept = [batch.column(c) for c in batch.schema.names if c != "text"]
                names = [c for c in batch.schema.names if c != "text"]
                for target, e in evidence.items():
                    kept.append(pa.array(e.sums(features, rows, batch.num_rows)))
                    names.append(f"e_{target}")
                yield pa.RecordBatch.from_arrays(kept, names)
    return run


def _evidence_of_features(evidence: dict[str, Evidence]):
    def run(batches):
        for batch in batches:
            lists = batch.column("features")
            count = np.asarray(lists.value_lengths()).astype(np.int64)
            values, rows = np.asarray(lists.flatten()).view(U64), np.repeat(np.arange(len(count)), count)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(t) for t in TARGETS], *[pa.array(e.sums(values, rows, len(count))) for e in evidence.values()]],
                [*TARGETS, *[f"e_{t}" for t in evidence]])
    return run


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> dict[str, Evidence]:
    """Evidence for each target from a bounded sample of labelled documents: one
    half of them (by hash) chooses and weighs the features, the other calibrates."""
    sample = None
    for target in TARGETS:
        one = _sample(labels, target, most).withColumnRenamed("label", target)
        sample = one if sample is None else sample.join(one, "doc_id", "full")
    # at most len(TARGETS) * most rows of an id and two labels
    half = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("half")), F.lit(2)).cast("int").alias("half")
    text = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", *TARGETS, half)
    fields = ", ".join(f"{t} int" for t in TARGETS)
    rows = written(text.mapInArrow(_feature_rows, f"{fields}, half int, features array<long>"), "quality-labelled")
    ones = {f"{t}{v}": F.sum(F.when(F.col(t) == v, 1).otherwise(0)) for t in TARGETS for v in (1, 0)}
    learned = rows.where("half = 0")
    total = learned.agg(*[c.alias(n) for n, c in ones.items()]).first()
    counts = written(learned.select(*TARGETS, F.explode("features").alias("feature")).groupBy("feature").agg(
        *[c.alias(n) for n, c in ones.items()]), "quality-counts")
    out = {}
    for target in TARGETS:
        n1, n0 = total[f"{target}1"] or 0, total[f"{target}0"] or 0
        m1, m0 = F.col(f"{target}1"), F.col(f"{target}0")
        a = F.log((m1 + SMOOTH) / (n1 - m1 + SMOOTH))
        b = F.log((m0 + SMOOTH) / (n0 - m0 + SMOOTH))
        # two shares compared, with their common share's spread
        common = (m1 + m0 + SMOOTH) / (n1 + n0 + 2 * SMOOTH)
        spread = F.sqrt(common * (1 - common) * (1 / (n1 + SMOOTH) + 1 / (n0 + SMOOTH)))
        gap = F.abs(m1 / (n1 + SMOOTH) - m0 / (n0 + SMOOTH))
        chosen = (counts.withColumn("weight", a - b)
                  .withColumn("z", gap / spread).where(F.col("z") >= MIN_Z)
                  .orderBy(F.desc("z"), "feature").limit(MOST_FEATURES).select("feature", "weight").toPandas())
        if not (n1 and n0):
            chosen = chosen.iloc[:0]
        out[target] = Evidence(chosen["feature"].to_numpy(np.int64).view(U64), chosen["weight"].to_numpy(float),
                               float(np.log((n1 + SMOOTH) / (n0 + SMOOTH))))
    scored = rows.where("half = 1").select(*TARGETS, "features").mapInArrow(
        _evidence_of_features(out), ", ".join([fields, *[f"e_{t} double" for t in TARGETS]]))
    for target in TARGETS:
        # evidence rounded to bins: a bounded number of rows
        bins = (scored.where(F.col(target).isNotNull()).groupBy(
                    F.round(f"e_{target}", 1).alias("e"))
                .agg(F.avg(target).alias("share"), F.count(F.lit(1)).alias("n")).toPandas())
        if len(bins) and 0 < (bins["share"] * bins["n"]).sum() < bins["n"].sum():
            out[target].calibrate(bins["e"].to_numpy(), bins["share"].to_numpy(), bins["n"].to_numpy(float))
    return out


def _strength(sites: DataFrame, around: Column | float) -> tuple[float, float]:
    """Mean and strength of a Beta prior from the spread of the sites' shares, by moments."""
    gap = F.col("share") - around
    r = sites.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * gap * gap).alias("gap"),
                  F.sum(F.col("n") * F.col("share")).alias("sum"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not r["n"]:
        return 0.5, 1.0
    mean = r["sum"] / r["n"]
    within = max(mean * (1 - mean), 1e-6)
    # the share of a site with n documents varies by within / n besides the sites' own spread
    own = max((r["gap"] - (r["k"] - 1) * within) / max(r["n"] - r["nn"] / r["n"], 1e-9), 1e-6)
    return mean, min(max(within / own - 1, 1.0), 1e4)


def site_sums(scored: DataFrame) -> DataFrame:
    """Documents and summed shares of each path."""
    shares = [c for c in scored.columns if c.startswith("p_")]
    return scored.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"sum_{c[2:]}") for c in shares])


def _posteriors(paths: DataFrame, target: str) -> tuple[DataFrame, float]:
    total = F.col(f"sum_{target}")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum(total).alias("sum"))
    whole = hosts.agg(F.sum("sum") / F.sum("n")).first()[0]
    mean = 0.5 if whole is None else whole
    _, a = _strength(hosts.withColumn("share", F.col("sum") / F.col("n")), F.lit(mean))
    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("sum").alias(f"host_sum_{target}"),
                         ((F.lit(a * mean) + F.col("sum")) / (a + F.col("n"))).alias(f"host_{target}"))
    paths = paths.select("host", "path", "n", total).join(hosts, "host")
    _, b = _strength(paths.withColumn("share", total / F.col("n")), F.col(f"host_{target}"))
    shrunk = (b * F.col(f"host_{target}") + total) / (b + F.col("n"))
    return paths.withColumns({f"path_{target}": shrunk, f"host_strength_{target}": F.lit(float(a)),
                              f"path_strength_{target}": F.lit(float(b))}), mean


def posteriors(scored: DataFrame, target: str) -> tuple[DataFrame, float]:
    """For a target, each path's and its host's documents, summed shares, posterior
    and strength of prior, and the corpus mean."""
    return _posteriors(site_sums(scored), target)


def _logit(p: Column) -> Column:
    inside = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(inside / (1 - inside))


def _with_sites(scored: DataFrame, sites: DataFrame) -> DataFrame:
    """Sites joined to their documents.  Those with over 1 / 1,024 of all documents
    are fewer than 1,024: they are shipped, so no hot site is a join's key."""
    total = sites.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * 1024 > total
    large = F.broadcast(sites.where(hot))
    small = scored.join(F.broadcast(sites.where(hot).select("host", "path")), ["host", "path"], "left_anti")
    return scored.join(large, ["host", "path"]).unionByName(small.join(sites.where(~hot), ["host", "path"]))


def combine(scored: DataFrame) -> DataFrame:
    """(doc_id, host, path, p_ of each target) with the sites' posteriors and the
    document's: its own log odds and those of its site's other documents,
    relative to the corpus."""
    paths = written(site_sums(scored), "quality-sites")
    sites, means = paths.select("host", "path", "n"), {}
    for target in TARGETS:
        of_target, means[target] = _posteriors(paths, target)
        held = of_target.drop("n") if target == TARGETS[0] else of_target.drop("n", "host_n")
        sites = sites.join(held, ["host", "path"])
    out = _with_sites(scored, written(sites, "quality-posteriors"))
    for target in TARGETS:
        p, a, b = F.col(f"p_{target}"), F.col(f"host_strength_{target}"), F.col(f"path_strength_{target}")
        host = (a * means[target] + F.col(f"host_sum_{target}") - p) / (a + F.col("host_n") - 1)
        path = (b * host + F.col(f"sum_{target}") - p) / (b + F.col("n") - 1)
        odds = _logit(p) + _logit(path) - _logit(F.lit(means[target]))
        out = out.withColumn(target, 1 / (1 + F.exp(-odds)))
    return out


def url_site(url: str) -> tuple[Column, Column]:
    """Host of a URL column and the first part of its path (a folder; empty for none)."""
    path = F.coalesce(F.try_parse_url(F.col(url), F.lit("PATH")), F.lit(""))
    return (F.lower(F.try_parse_url(F.col(url), F.lit("HOST"))), F.regexp_extract(path, "^/+([^/]+)/", 1))


def score_quality(docs: DataFrame, labels: DataFrame, host: str | Column = "source", path: str | Column = "lang",
                  most: int = MOST_LABELS) -> DataFrame:
    """A row for each document: the classifier's share, the host's and path's
    posterior and the document's, for quality and toxicity; ``kept`` is a good
    document that is not toxic.  ``host`` and ``path`` are columns or expressions
    (``url_site`` gives both from a URL)."""
    site = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    evidence = fit(docs, labels, most)
    schema = "doc_id long, host string, path string, " + ", ".join(f"e_{t} double" for t in TARGETS)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", site(host).alias("host"),
                         site(path).alias("path")).mapInArrow(_apply(evidence), schema)
    shares = {f"p_{t}": 1 / (1 + F.exp(-(F.lit(e.slope) * F.col(f"e_{t}") + e.prior))) for t, e in evidence.items()}
    out = combine(written(scored.withColumns(shares), "quality-evidence"))
    out = out.withColumn("kept", (F.col("quality") >= 0.5) & (F.col("toxic") < 0.5))
    return out.select("doc_id", "host", "path", *[c.format(t) for t in TARGETS
                                                  for c in ("p_{}", "host_{}", "path_{}", "{}")], "kept")


def op2_quality_bayes(spark, sf_dir):
    return score_quality(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
