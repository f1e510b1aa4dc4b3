"""Physical-plan properties that matter at scale."""

from tests.conftest import SF01
from textbench import testbed
from textbench.operators import sampling
from textbench.plans import grid


def _plan(df) -> str:
    qe = df._jdf.queryExecution()
    qe.executedPlan()
    return qe.explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def _joins(plan: str) -> int:
    tree = plan.split("\n\n(")[0]
    return sum(tree.count(j) for j in ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin"))


def test_sample_prunes_text_and_needs_no_window(spark):
    c = testbed.corpus(spark, SF01)
    plan = _plan(sampling.balanced_sample(c, 100, 42).select("dataset", "doc_id", "label"))
    schemas = [l for l in plan.splitlines() if l.startswith("ReadSchema")]
    assert schemas and all("text" not in s for s in schemas)
    assert "windowspecdefinition" not in plan  # rows are compared with their group's cutoff


def test_splits_join_labels_and_documents_once(spark):
    import __spark_entry__ as E
    # one join of labels and documents, and one broadcast of cutoffs per draw
    assert _joins(_plan(E.queries()["x7_stratified_split"](spark, SF01))) <= 2
    assert _joins(_plan(E.queries()["x8_validation_split"](spark, SF01))) <= 3


def test_job_reads_the_texts_once_and_never_shuffles_them(spark):
    c, t = testbed.corpus_keys(spark, SF01), testbed.texts(spark, SF01)
    plan = _plan(grid.drawn_rows(c, 100, 42, 3, t, 2))
    text_scans = [l for l in plan.splitlines() if l.startswith("ReadSchema") and "text" in l]
    assert len(text_scans) == 1
    shuffled = [l for l in plan.splitlines() if l.startswith("Input") and "text#" in l]
    exchanges = plan.split("Exchange\n")[1:]
    assert all("text#" not in e.split("\n\n")[0] for e in exchanges), shuffled


def test_grid_has_no_cartesian_product(spark):
    c = testbed.corpus(spark, SF01)
    g = grid.run_grid(spark, c, testbed.rule_models(), testbed.STRATEGIES, list(testbed.TABLE_DATASETS),
                      sample_size=100, timing="prompt_length", model_names=testbed.MODEL_NAMES)
    plan = _plan(g)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_registered_query_uses_a_cross_or_nested_loop_join(spark):
    import __spark_entry__ as E
    from tests.conftest import SF001
    bad = []
    for name, q in E._QUERIES.items():
        if name == "m7_trained_baseline":  # fits models eagerly; its frames are checked elsewhere
            continue
        plan = _plan(q(spark, SF001))
        if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
            bad.append(name)
    assert bad == []


def test_texts_are_attached_by_broadcast_probe(spark):
    from textbench.sources.datasets import attach_text
    keys = testbed.corpus_keys(spark, SF01)
    drawn = attach_text(sampling.balanced_sample(keys, 100, 42), testbed.texts(spark, SF01))
    plan = _plan(drawn)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    text_scans = [l for l in plan.splitlines() if l.startswith("ReadSchema") and "text" in l]
    assert len(text_scans) == 1  # the text table is read once, as the streamed side
    assert drawn.count() == 200
