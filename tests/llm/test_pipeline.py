"""The pipeline's stages, and what every registered query must hold."""

import hashlib
import re

import numpy as np

from tests.conftest import SF001
from tests.llm.conftest import make
from tests.llm.test_filters import _expected_lines
from tests.llm.test_texts import _components, ranks, tiktoken_encoding  # noqa: F401
from textbench.llm import line_quality, minhash, pii


def test_pipeline_against_brute_force(spark, docs, tiktoken_encoding, tmp_path):  # noqa: F811
    import corpus_pipeline
    folder = str(tmp_path)
    secret = make(spark, ["please write to some.body@mail.example.com about the words of this text today"], [500])
    bench = [(1, "which of the following seven numbers is the largest one of them all")]
    leak = make(spark, ["here it comes. " + bench[0][1] + " and some more words"], [501])
    own = [" ".join(f"{k}v{i}" for i in range(40)).split() for k in "abcdefghij"]
    # one footer in ten texts of a host: above its limit of five; and a text of few own words
    footer = "All 24 sections of this site are listed in the footer of each page of it"
    listed = make(spark, [" ".join(w) + "\n" + footer for w in own] + [f"few own words\n{footer}"],
                  [600 + 3 * i for i in range(11)])
    # at a similarity between 0.80 and 0.85 (34 of 42), and below 0.80 (33 of 43)
    copies = [" ".join(x + "z" for x in own[0]), " ".join([x + "z" for x in own[0][:38]] + ["one", "two"]),
              " ".join([x + "z" for x in own[0][:37]] + ["t1", "t2", "t3"]),
              " ".join(["c1", "c2"] + [x + "z" for x in own[0][2:38]] + ["c3", "c4"])]
    near = make(spark, copies, [700, 701, 702, 703])
    rows = docs.unionByName(secret).unionByName(leak).unionByName(listed).unionByName(near)
    rows.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    lines = _expected_lines(rows.collect(), line_quality.MIN_DOCUMENTS)
    assert sum(x[6] > 0 for x in lines.values()) == 10 and not lines[630][-1]
    # a line goes with the line feed that ends it: the last one has none
    left = {r["doc_id"]: (r["text"] or "").replace(footer, "" if r["doc_id"] != 600 else footer)
            for r in rows.collect() if lines[r["doc_id"]][-1]}
    groups = _components(list(left.items()), 80)
    assert sum(not g[2] for g in groups.values()) > sum(not g[2] for g in _components(list(left.items())).values())
    want = {i: text for i, text in left.items() if groups[i][2] and i != 501}
    want[500] = "please write to <EMAIL> about the words of this text today"
    assert set(got) == set(want)
    for i, text in want.items():
        ids = tiktoken_encoding.encode_ordinary(text)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_stages_return_the_columns_of_their_input(spark, docs, odd, empty):
    import corpus_pipeline
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "line_quality", "near_duplicates", "decontamination", "personal_data", "encoding"]
    for d in (odd, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, d, SF001)
            assert out.columns == d.columns and out.count() <= d.count(), name


def test_no_cross_join_and_no_local_checkpoint(spark, docs):
    import __spark_entry__ as E
    plans = [line_quality.keep_documents(docs), minhash.keep_one(docs), pii.mask_personal_data(docs)]
    for df in plans:
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", df._jdf.queryExecution().toString())
    names = set(E.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
