"""Columns named like the operators' helpers, and ids that rows share."""

import re

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import texts
from textbench.llm import byte_bpe, decontaminate, line_quality, minhash, pii, substring_dedup
from textbench.llm.common import free_prefix

HELPERS = ["h_doc_id", "H_Spans", "_h_masked", "h_lines", "h_kept", "content", "lines", "__digit", "__spans", "__every", "__m_email",
           "__b_email", "__s_email", "__masked", "__lines", "__doc_id", "kept", "n_words", "words", "base_failed", "host",
           "line", "block", "pack", "ids", "n_removed_words", "n_repeat_words", "spans", "grams", "component", "least"]
BENCH = "What is the capital city of the country that lies between two rivers and the sea ?"


@pytest.fixture(scope="module")
def plain(spark):
    own = [t for t in texts() if t is None or len(t) < 20_000]
    own += [f"Please write to bob{i}@example.org or call +49 30 1234567 about the offer number {i} of this year" for i in range(4)]
    own += [BENCH + " and some more words that follow here for the length of it"]
    rows = [(i, t, "en", f"host{i % 3}", len(t or "")) for i, t in enumerate(own)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").persist()


@pytest.fixture(scope="module")
def clashing(plain):
    return plain.select("*", *[F.concat(F.lit(f"{c}:"), "doc_id").alias(c) for c in HELPERS])


def _stages(spark):
    bench = spark.createDataFrame([(1, BENCH)], "item_id long, text string")
    return {
        "lines": line_quality.keep_documents, "near": minhash.keep_one, "pii": pii.mask_personal_data,
        "bench": lambda d: decontaminate.drop_contaminated(d, bench),
        "bpe": byte_bpe.round_trip, "judge": line_quality.judge, "spans": pii.find_personal_data,
        "substrings": substring_dedup.remove_repeated,
    }


@pytest.mark.parametrize("stage", ["lines", "near", "pii", "bench", "judge", "spans", "substrings"])
def test_helper_names_replace_no_column(spark, plain, clashing, stage):
    run = _stages(spark)[stage]
    want = {r["doc_id"]: r.asDict() for r in run(plain).collect()}
    got = run(clashing)
    if stage in ("lines", "near", "pii", "bench"):
        assert got.columns == clashing.columns
        for r in got.collect():
            assert {c: r[c] for c in HELPERS} == {c: f"{c}:{r['doc_id']}" for c in HELPERS}
    got = {r["doc_id"]: {k: r[k] for k in want[r["doc_id"]]} for r in got.collect()}
    assert got == want


def test_free_prefix():
    assert free_prefix(["a", "b"]) == "h_"
    assert free_prefix(["H_x"]) == "_h_" and free_prefix(["h_", "_H_y"]) == "__h_"


def test_rows_of_one_id_are_judged_by_their_own_words(spark):
    good = [" ".join("abcdefgh"[i] + chr(97 + k % 26) + chr(97 + k // 26) for k in range(30)) for i in range(8)]
    footer = "all rights reserved by the owner of this site"
    rows = [(50, "short", "h"), (50, good[0], "h"), (50, good[1] + "\n" + footer, "h"), (50, good[1] + "\n" + footer, "h")]
    rows += [(i, good[i - 50] + "\n" + footer, "h") for i in range(53, 58)] + [(3, good[2] + "\n" + footer, "h"), (None, "x", "h")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text"))
    verdict = sorted((str(r["doc_id"]), r["n_words"], r["n_removed_words"], r["kept"])
                     for r in line_quality.judge(d, min_documents=4).collect())
    nine = len(footer.split())
    assert verdict == sorted([("50", 1, 0, False), ("50", 30, 0, True), ("50", 39, nine, True), ("50", 39, nine, True),
                              ("3", 39, 0, True), ("None", 1, 0, False)] + [(str(i), 39, nine, True) for i in range(53, 58)])
    out = [(r["doc_id"], re.sub(r"\s+", " ", r["text"]).strip(), r["n_chars"] == len(r["text"]))
           for r in line_quality.keep_documents(d, min_documents=4).collect()]
    want = [(50, good[0], True), (50, good[1], True), (50, good[1], True), (3, f"{good[2]} {footer}", True), (None, "x", True)]
    assert sorted(map(str, out)) == sorted(map(str, want + [(i, good[i - 50], True) for i in range(53, 58)]))
