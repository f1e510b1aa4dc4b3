"""

reads the driver's test tables (``documents``, ``labels``,
``conversations``) through the library and runs over whole tables; the
benchmark parameters are the engine's: balanced samples of 100 rows
(50 per class), seed 42, three few-shot examples, 2,000-character texts.
"""

from __future__ import annotations

import importlib.util
import os
import sys
from collections.abc import Callable

_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import oracle_sql as O  # noqa: E402
from textbench import testbed  # noqa: E402
from textbench.functions import parsing, prompts, text  # noqa: E402
from textbench.operators import metrics, profile, sampling  # noqa: E402
from textbench.plans import analysis, grid  # noqa: E402

# the training-data operators are optional: everything else works without them
_llm = None
if importlib.util.find_spec("textbench.llm") and importlib.util.find_spec("textbench.llm.queries"):
    from textbench.llm import queries as _llm  # noqa: E402

SAMPLE_SIZE = 100
SEED = 42
N_EXAMPLES = 3
MAX_LEN = 2000
DATASETS = list(testbed.TABLE_DATASETS)
STRATEGIES = testbed.STRATEGIES
ROUND = O.R

_cache: dict = {}


def _corpus(spark, sf):
    return testbed.corpus(spark, sf)


def _grid(spark, sf) -> DataFrame:
    """Flat grid metrics, persisted per session and input (bounded: one row
    per experiment) so the analysis queries share one grid run."""
    k = (spark.sparkContext.applicationId, sf)
    if k not in _cache:
        # sample on keys and labels only; texts are attached to the drawn rows
        g = grid.run_grid(spark, _keys(spark, sf), testbed.rule_models(), STRATEGIES, DATASETS,
                          sample_size=SAMPLE_SIZE, seed=SEED, n_examples=N_EXAMPLES,
                          max_text_length=MAX_LEN, timing="prompt_length", model_names=testbed.MODEL_NAMES,
                          texts=testbed.texts(spark, sf))
        _cache[k] = g.persist()
    return _cache[k]


def _report(spark, sf) -> DataFrame:
    return analysis.flat_report(_grid(spark, sf))


def _ok(spark, sf) -> DataFrame:
    """Successful experiments only: the analysis never sees failed cells."""
    return analysis.successful(_report(spark, sf))


def _r(c, digits=ROUND):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _keys(spark, sf) -> DataFrame:
    """Keys and labels: every draw is made on these, texts are attached after."""
    return testbed.corpus_keys(spark, sf)


# --------------------------------------------------------------------------- dataset layer

def q_s1_corpus(spark, sf):
    c = _corpus(spark, sf)
    return c.select("dataset", "doc_id", "label", text.text_length("text").alias("text_length"))


def q_a1_dataset_stats(spark, sf):
    s = profile.dataset_stats(_corpus(spark, sf))
    return s.withColumn("avg_text_length", _r("avg_text_length"))


def q_a2_dataset_comparison(spark, sf):
    out = profile.dataset_comparison(profile.dataset_stats(_corpus(spark, sf)), DATASETS)
    return out.select("stat", *[_r(d).alias(d) for d in DATASETS])


def q_a3_class_distribution(spark, sf):
    return profile.class_distribution(_corpus(spark, sf)).select("dataset", "label", "n")


def q_a4_class_share(spark, sf):
    return profile.class_distribution(_corpus(spark, sf)).withColumn("share_pct", _r("share_pct"))


def q_a5_length_box(spark, sf):
    return profile.length_box_stats(_corpus(spark, sf))


def q_a7_max_length(spark, sf):
    return _corpus(spark, sf).groupBy("dataset").agg(F.max(text.text_length("text")).alias("max_text_length"))


def q_p11_preview(spark, sf):
    c = _corpus(spark, sf)
    pv = F.substring("text", 1, 500)
    return c.select("dataset", "doc_id", F.md5(pv).alias("preview_md5"), F.char_length(pv).alias("preview_len"))


# --------------------------------------------------------------------------- sampling and joins

def q_x1_balanced_sample(spark, sf):
    return sampling.balanced_sample(_keys(spark, sf), SAMPLE_SIZE, SEED).select("dataset", "doc_id", "label")


def q_x2_simple_sample(spark, sf):
    return sampling.simple_sample(_keys(spark, sf), SAMPLE_SIZE, SEED).select("dataset", "doc_id", "label")


def q_x4_balanced_examples(spark, sf):
    # the smallest test tables leave a class without rows: the query shows what is there
    ex = sampling.balanced_few_shot_examples(_keys(spark, sf), SAMPLE_SIZE, N_EXAMPLES, SEED, strict=False)
    return ex.select("dataset", "doc_id", "label", "example_rank")


def q_x5_few_shot_examples(spark, sf):
    ex = sampling.few_shot_examples(_keys(spark, sf), SAMPLE_SIZE, N_EXAMPLES, SEED)
    return ex.select("dataset", "doc_id", "label", "example_rank")


def q_j1_example_pool(spark, sf):
    pool = sampling.example_pool(_keys(spark, sf), SAMPLE_SIZE, SEED)
    return pool.groupBy("dataset").agg(F.count(F.lit(1)).alias("pool_rows"))


def q_x7_stratified_split(spark, sf):
    a = sampling.stratified_assignment(_keys(spark, sf), 0.2, SEED)
    return a.select("dataset", "doc_id", "label", "split")


def q_x6_holdout_split(spark, sf):
    a = sampling.holdout_assignment(spark, _keys(spark, sf), SAMPLE_SIZE, 0.2, SEED)
    return a.select("dataset", "doc_id", "label", "split")


def q_x8_validation_split(spark, sf):
    a = sampling.three_way_assignment(_keys(spark, sf), SAMPLE_SIZE, 0.2, SEED)
    return a.where("split != 'test'").select("dataset", "doc_id", "label", "split")


# --------------------------------------------------------------------------- prompts

def q_f1_truncate(spark, sf):
    d = testbed.table(spark, sf, "documents")
    cols = []
    for m in (10, 100, 1000, 2000):
        t = text.truncate_text("text", m)
        cols += [F.char_length(t).alias(f"len_{m}"), F.md5(t).alias(f"md5_{m}")]
    return d.select("doc_id", *cols)


def q_f2_f5_prompts(spark, sf):
    """Zero-shot and chain-of-thought prompts of every labelled document, the texts read once."""
    rows = _corpus(spark, sf).withColumn("strategy", F.explode(F.array(F.lit("zero_shot"), F.lit("chain_of_thought"))))
    p = prompts.build_prompt_by_strategy("text", "strategy", F.lit(None).cast("string"), MAX_LEN)
    return rows.select("dataset", "doc_id", "strategy", F.md5(p).alias("prompt_md5"), F.char_length(p).alias("prompt_len"))


def _drawn_with_text(spark, sf):
    """Test rows and few-shot examples drawn on keys, texts attached in one probe."""
    return grid.drawn_rows(_keys(spark, sf), SAMPLE_SIZE, SEED, N_EXAMPLES, testbed.texts(spark, sf), len(DATASETS))


def q_f3_few_shot_prompts(spark, sf):
    drawn = _drawn_with_text(spark, sf)
    block = prompts.few_shot_block(drawn.where("NOT _test"), by=["dataset"], max_text_length=MAX_LEN)
    p = prompts.build_prompt("text", "few_shot", "examples_text", MAX_LEN)
    return drawn.where("_test").join(F.broadcast(block), "dataset").select(
        "dataset", "doc_id", F.md5(p).alias("prompt_md5"), F.char_length(p).alias("prompt_len"))


def q_f4_example_block(spark, sf):
    ex = _drawn_with_text(spark, sf).where("NOT _test")
    b = prompts.few_shot_block(ex, by=["dataset"], max_text_length=MAX_LEN)
    return b.select("dataset", F.md5("examples_text").alias("block_md5"),
                    F.char_length("examples_text").alias("block_len"), "n_examples")


def q_f6_step_prompts(spark, sf):
    """The extra chain-of-thought template, through the prompt builder, for every document."""
    p = prompts.build_prompt("text", "chain_of_thought_steps", None, MAX_LEN)
    return testbed.table(spark, sf, "documents").select("doc_id", F.md5(p).alias("prompt_md5"),
                                                        F.char_length(p).alias("prompt_len"))


def q_f10_classification_prompt(spark, sf):
    """The convenience wrapper, few-shot, with one example block for the rows of each corpus."""
    drawn, out = _drawn_with_text(spark, sf).where("NOT _test"), []
    for d in DATASETS:
        c = _corpus(spark, sf).where(F.col("dataset") == d)
        out.append(prompts.classification_prompt(c, "few_shot", drawn.where(F.col("dataset") == d), MAX_LEN))
    return out[0].unionByName(out[1]).select("dataset", "doc_id", F.md5("prompt").alias("prompt_md5"),
                                             F.char_length("prompt").alias("prompt_len"))


def q_f7_alternative_prompts(spark, sf):
    d = testbed.table(spark, sf, "documents")
    cols = []
    for name in O.ALT_NAMES:
        p = prompts.fill(prompts.get_template(name), text=text.truncate_text("text", MAX_LEN))
        cols.append(F.md5(p).alias(f"{name}_md5"))
    return d.select("doc_id", *cols)


def q_f11_chat_messages(spark, sf):
    c = _corpus(spark, sf)
    msgs = prompts.chat_messages(prompts.build_prompt("text", "zero_shot", None, MAX_LEN))
    return c.select("dataset", "doc_id", F.size(msgs).alias("n_messages"),
                    msgs[0]["role"].alias("role_0"), msgs[1]["role"].alias("role_1"),
                    F.md5(msgs[0]["content"]).alias("content_0_md5"), F.md5(msgs[1]["content"]).alias("content_1_md5"))


def q_f20_backend_names(spark, sf):
    """Loose comparison form of back-end names made from every document's source and language."""
    d = testbed.table(spark, sf, "documents")
    name = F.concat(F.element_at(F.array(F.lit(" https://huggingface.co/Hub/"), F.lit("hf.co/Org/"), F.lit("Local-")),
                                 (F.col("doc_id") % 3 + 1).cast("int")), F.upper("source"), F.lit(":"), F.upper("lang"))
    return d.select("doc_id", text.normalize_backend_name(name).alias("backend_name"))


def q_j6_resolved_backends(spark, sf):
    """Names configured for the sources, resolved against a listing made from the documents."""
    from textbench.operators import registry
    d = testbed.table(spark, sf, "documents")
    sources = d.groupBy("source").agg(F.min("doc_id").alias("position"))
    configured = sources.select(F.col("source").alias("model"),
                                F.concat(F.lit("hf.co/Org/"), "source", F.lit(":latest")).alias("backend_name"))
    listed = sources.where("source LIKE '%1%'").select(
        F.concat(F.lit("https://huggingface.co/org/"), F.upper("source")).alias("name"), "position")
    return registry.resolve_backend_names(configured, listed)


# --------------------------------------------------------------------------- parsing, scoring, metrics

def q_f12_parse_conversations(spark, sf):
    conv = testbed.table(spark, sf, "conversations")
    return conv.select("conv_id", "turn", "role", parsing.extract_prediction("text").alias("prediction"))


def _grid_flat(g):
    cols = [c for c in g.columns if c not in ("confusion_matrix", "avg_inference_time", "total_inference_time")]
    return g.select(*cols, _r("avg_inference_time").alias("avg_inference_time"),
                    _r("total_inference_time").alias("total_inference_time"))


def q_m6_grid(spark, sf):
    return _grid_flat(_grid(spark, sf))


def q_a8_confusion_matrix(spark, sf):
    return _grid(spark, sf).where("error IS NULL").select("model", "strategy", "dataset", "confusion_matrix")


def _corpus_predictions(spark, sf):
    """Every labelled document scored zero-shot by every rule model."""
    c = _corpus(spark, sf)
    p = c.select("dataset", "doc_id", "label", prompts.build_prompt("text", "zero_shot", None, MAX_LEN).alias("prompt"))
    # one row per (document, model): a generator over the model names, no join
    p = p.withColumn("model", F.explode(F.array(*[F.lit(m) for m in testbed.RULE_SQL])))
    from textbench.operators.scoring import score
    scored = score(p, testbed.rule_models(), timing="prompt_length")
    return scored.withColumn("prediction", parsing.extract_prediction("response"))


def q_m1_score_corpus(spark, sf):
    # counters and timing in one aggregate: every row is scored once
    agg = _corpus_predictions(spark, sf).groupBy("model", "dataset").agg(*metrics.counter_aggs(), *metrics.timing_aggs())
    named = [c.alias(n) for c, n in zip(metrics.metric_columns(), metrics.METRIC_NAMES) if n != "confusion_matrix"]
    return agg.select("model", "dataset", "n", *named, _r("avg_inference_time").alias("avg_inference_time"))


def _broken_backend():
    raise RuntimeError("the back end cannot be opened")


def q_m5_isolation(spark, sf):
    """A model whose back end cannot be opened fails its own cells only."""
    from textbench.operators.scoring import PythonModel
    good = [m for m in testbed.rule_models() if isinstance(m, PythonModel)]
    g = grid.run_grid(spark, _keys(spark, sf), [*good, PythonModel("rules/broken-3B", _broken_backend)], STRATEGIES,
                      DATASETS, sample_size=SAMPLE_SIZE, seed=SEED, n_examples=N_EXAMPLES, max_text_length=MAX_LEN,
                      timing="prompt_length", texts=testbed.texts(spark, sf))
    return g.select("model", "strategy", "dataset", "error", "n", "f1_score")


def _asks_by_options():
    def generate(prompt_texts, options):
        def answer(p):
            return "Falsa" if len(p) % options["max_new_tokens"] < 10 * options["temperature"] else "Verdadeira"
        return prompt_texts.map(answer)
    return generate


def _scratch(spark, name):
    import uuid

    from textbench.session import scratch_path
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def q_m2_row_options(spark, sf):
    """Two option sets in one grid, by strategy and dataset, recorded in each scored row."""
    from textbench.operators.scoring import ExprModel, PythonModel
    models = [ExprModel("rules/options-2B", "CASE WHEN length(prompt) % options.max_new_tokens < 3 THEN 'Falsa' "
                                            "ELSE 'Verdadeira' END", options={"temperature": 0.5}),
              PythonModel("rules/options-py-3B", _asks_by_options)]
    tokens = F.when(F.col("strategy") == "zero_shot", 4).when(F.col("strategy") == "few_shot", 16)
    path = _scratch(spark, "options")
    grid.run_grid(spark, _keys(spark, sf), models, STRATEGIES, DATASETS, sample_size=SAMPLE_SIZE, seed=SEED,
                  n_examples=N_EXAMPLES, max_text_length=MAX_LEN, texts=testbed.texts(spark, sf), predictions_path=path,
                  row_options=F.struct(tokens.alias("max_new_tokens"),
                                       F.when(F.col("dataset") == "toxic", 0.9).alias("temperature")))
    return spark.read.parquet(path).groupBy("model", "strategy", "dataset", "options.max_new_tokens", "options.temperature") \
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction") == 1).alias("answered_fake"))


def q_j5_backends(spark, sf):
    """Back-end names of the documents' sources, looked up in a registry that knows some of them."""
    from textbench.operators import registry
    sources = testbed.table(spark, sf, "documents").select(F.col("source").alias("model"))
    known = sources.distinct().where("model LIKE '%1%'").select("model", F.concat(F.lit("hub/"), "model").alias("backend_name"))
    return registry.backend_lookup(sources, known)


def q_p6_error_analysis(spark, sf):
    preds = _corpus_predictions(spark, sf)
    return metrics.error_summary(preds, ["model", "dataset"]).withColumn("error_rate", _r("error_rate"))


def q_a28_first_false_positive(spark, sf):
    preds = _corpus_predictions(spark, sf)
    fp = metrics.false_positives(preds)
    return metrics.first_example(fp, ["model", "dataset"]).select("model", "dataset", "doc_id")


# --------------------------------------------------------------------------- results and analysis

def q_p7_report(spark, sf):
    r = _report(spark, sf)
    return r.select("model", "strategy", "dataset", "accuracy", "precision", "recall", "f1_score",
                    _r("avg_inference_time").alias("avg_inference_time"), "vram_usage_gb", "invalid_rate", "error")


def q_l1_report_ranked(spark, sf):
    from pyspark.sql import Window
    r = _report(spark, sf)
    w = Window.orderBy(F.desc_nulls_last("f1_score"), "model", "strategy", "dataset")
    return r.select("model", "strategy", "dataset", "f1_score", F.row_number().over(w).alias("rank"))


def _means(df, key):
    return df.select(key, *[_r(c).alias(c) for c in df.columns if c != key])


def q_a14_by_strategy(spark, sf):
    return _means(analysis.means_by(_ok(spark, sf), "strategy"), "strategy")


def q_a15_by_model(spark, sf):
    return _means(analysis.means_by(_ok(spark, sf), "model"), "model")


def q_a16_grouped_means(spark, sf):
    g = analysis.grouped_means(_ok(spark, sf))
    return g.select("dimension", "value", _r("f1_score").alias("f1_score"), _r("accuracy").alias("accuracy"),
                    _r("avg_inference_time").alias("avg_inference_time"))


def q_a17_best_strategy_per_model(spark, sf):
    b = analysis.best_per_group(_ok(spark, sf), "model", "strategy")
    return b.select("model", _r("mean_f1_score").alias("mean_f1_score"), "best_strategy")


def q_a17_best_model_per_strategy(spark, sf):
    b = analysis.best_per_group(_ok(spark, sf), "strategy", "model")
    return b.select("strategy", _r("mean_f1_score").alias("mean_f1_score"), "best_model")


def q_a18_best_overall(spark, sf):
    return analysis.best_overall(_ok(spark, sf)).select("model", "strategy", "dataset", "f1_score")


def q_a20_compare_models(spark, sf):
    p = analysis.compare_models(_ok(spark, sf), STRATEGIES, DATASETS)
    return p.select("model", *[_r(F.col(f"`{c}`")).alias(c) for c in p.columns if c != "model"])


def q_a21_heatmap_strategy(spark, sf):
    p = analysis.heatmap(_ok(spark, sf), "strategy", STRATEGIES)
    return p.select(text.short_model_name("model").alias("short_model"), *[_r(c).alias(c) for c in STRATEGIES])


def q_a22_heatmap_dataset(spark, sf):
    p = analysis.heatmap(_ok(spark, sf), "dataset", DATASETS)
    return p.select(text.short_model_name("model").alias("short_model"), *[_r(d).alias(d) for d in DATASETS])


def q_a23_statistical_analysis(spark, sf):
    s = analysis.statistical_analysis(_ok(spark, sf))
    return s.select("model_strategy", *[_r(c).alias(c) for c in ("mean", "std", "min", "max")], "n")


def q_a24_parameter_trend(spark, sf):
    t = analysis.parameter_trend(_ok(spark, sf))
    return t.select("metric", _r("slope").alias("slope"), _r("intercept").alias("intercept"), "n")


def q_a24_fitted_values(spark, sf):
    """Every experiment beside the trend of its metric."""
    t = analysis.fitted_values(_ok(spark, sf))
    return t.select("model", "strategy", "dataset", "metric", "num_parameters", _r("value").alias("value"),
                    _r("fitted").alias("fitted"))


def q_a27_split_sizes(spark, sf):
    """Train and test sizes of the hold-out split."""
    return analysis.split_sizes(sampling.holdout_assignment(spark, _keys(spark, sf), SAMPLE_SIZE, 0.2, SEED))


def q_a27_inventory(spark, sf):
    """Files, loaded, successful and failed documents of the grid, written and read again."""
    from textbench.sources import results
    path = _scratch(spark, "results")
    results.write_results(grid.as_results(_grid(spark, sf)), path)
    return results.result_inventory(spark, path)


def q_s9_flat_documents(spark, sf):
    """The grid's documents under their published names, written and read again."""
    from textbench.sources import results
    path = _scratch(spark, "flat")
    results.write_flat_results(grid.as_results(_grid(spark, sf)), path)
    back = results.read_flat_results(spark, path)
    return back.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "model", "strategy", "dataset",
                       "error", "sample_size", "metrics.f1_score", "metrics.true_positives")


def q_s10_csv_report(spark, sf):
    """The report table as CSV, read again."""
    from textbench.sources import results
    path = _scratch(spark, "report")
    results.write_csv(_report(spark, sf).select("model", "strategy", "dataset", "error", "f1_score", "invalid_rate"), path)
    return spark.read.schema("model string, strategy string, dataset string, error string, f1_score double, "
                             "invalid_rate double").option("header", True).option("escape", '"').csv(path)


def q_a25_parameter_bins(spark, sf):
    b = analysis.parameter_bins(_ok(spark, sf))
    return b.select("param_range", _r("f1_score").alias("f1_score"), "n")


def q_a6_f1_box_by_strategy(spark, sf):
    b = profile.box_stats(analysis.successful(_report(spark, sf)), "f1_score", ["strategy"])
    return b.select("strategy", "n", *[_r(c).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")],
                    "n_outliers")


def q_a6_f1_box_by_model(spark, sf):
    b = profile.box_stats(analysis.successful(_report(spark, sf)), "f1_score", ["model"])
    return b.select("model", "n", *[_r(c).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")],
                    "n_outliers")


def q_a6_f1_box_by_dataset(spark, sf):
    b = profile.box_stats(analysis.successful(_report(spark, sf)), "f1_score", ["dataset"])
    return b.select("dataset", "n", *[_r(c).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")],
                    "n_outliers")


def q_a26_distinct_values(spark, sf):
    return analysis.distinct_values(_ok(spark, sf))


def q_a27_counts(spark, sf):
    return analysis.counts(_report(spark, sf))


def q_f13_f18_model_parameters(spark, sf):
    r = _ok(spark, sf).select("model").distinct()
    p = text.model_parameters("model")
    return r.select("model", p.alias("num_parameters"), text.parameter_bin(p).alias("param_range"),
                    text.short_model_name("model").alias("short_model"),
                    text.experiment_key("model", F.lit("zero_shot"), F.lit("quality")).alias("zero_shot_key"))


def q_j4_pending_cells(spark, sf):
    g = grid.experiment_grid(spark, testbed.MODEL_NAMES, STRATEGIES, DATASETS)
    return grid.pending_cells(g, _grid(spark, sf))


def q_l4_latest_results(spark, sf):
    """Newest document per experiment of an append-only table: the grid's, and a
    later round of its zero-shot cells."""
    from textbench.sources import datasets, results
    g = _grid(spark, sf).select("model", "strategy", "dataset", "error", "sample_size", "f1_score")
    first = g.withColumn("timestamp", F.lit("2026-01-01T00:00:00.000000"))
    later = (g.where("strategy = 'zero_shot'").withColumn("timestamp", F.lit("2026-01-02T00:00:00.000000"))
             .withColumn("sample_size", F.col("sample_size") + 1))
    return results.latest_results(datasets.union_corpora([first, later]))


def q_m12_report_models(spark, sf):
    """Report rows with the description of their model."""
    from textbench.operators import registry
    info = registry.model_info(spark, testbed.MODEL_NAMES)
    r = registry.report_with_models(_ok(spark, sf), info)
    return r.select("model", "strategy", "dataset", "f1_score", "backend_name", "num_parameters")


def q_m7_trained_baseline(spark, sf):
    """Supervised baselines (Spark ML pipeline): the protocol, which SQL can state:
    who ran, on how many test rows of each class.  The fitted quality is tested
    against a majority-class floor."""
    from textbench.operators import trained
    out = trained.run_baselines(spark, _keys(spark, sf), DATASETS, sample_size=SAMPLE_SIZE,
                                texts=testbed.texts(spark, sf))
    return out.select("model", "strategy", "dataset", "error", "n",
                      (F.col("true_negatives") + F.col("false_positives")).alias("actual_negatives"),
                      (F.col("false_negatives") + F.col("true_positives")).alias("actual_positives"))


# --------------------------------------------------------------------------- landed files

def q_s1_landed_corpus(spark, sf):
    """A landed JSON-lines copy of documents and labels, read through the registry."""
    import uuid

    from textbench.session import scratch_path
    from textbench.sources import datasets
    folder = scratch_path(spark, f"landed-{uuid.uuid4().hex}")
    d = testbed.table(spark, sf, "documents").join(testbed.table(spark, sf, "labels"), "doc_id")
    d.select(F.col("doc_id").alias("key"), F.col("text").alias("body"), "quality").write.json(f"{folder}/landed.json")
    registry = {"landed": {"id_column": "key", "text_column": "body", "label_column": "quality",
                           "label_mapping": {"1": 0, "0": 1}}}
    c = datasets.read_dataset(spark, "landed", folder, registry, schema="key long, body string, quality int",
                              multi_line_json=False)
    return c.select("dataset", "doc_id", "label", F.md5("text").alias("text_md5"))


def q_s3_csv_corpus(spark, sf):
    """A landed CSV copy of the documents, line breaks and quotes inside the fields, read through the registry."""
    from textbench.sources import datasets
    folder = _scratch(spark, "landed")
    d = testbed.table(spark, sf, "documents").join(testbed.table(spark, sf, "labels"), "doc_id")
    (d.select(F.col("doc_id").alias("key"), F.col("text").alias("body"), F.col("toxic").alias("flag"))
     .write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(f"{folder}/landed.csv"))
    registry = {"landed": {"id_column": "key", "text_column": "body", "label_column": "flag",
                           "label_mapping": {"0": 0, "1": 1}}}
    c = datasets.read_dataset(spark, "landed", folder, registry, schema="key long, body string, flag int")
    return c.select("dataset", "doc_id", "label", F.md5("text").alias("text_md5"))


def q_p2_unmapped_labels(spark, sf):
    """Raw label values outside the map, counted: here the map knows one value only."""
    from textbench.sources import datasets
    labels = testbed.table(spark, sf, "labels")
    parts = [datasets.apply_label_mapping(labels.select(F.lit(name).alias("dataset"), "doc_id",
                                                        F.col(name).alias("label")), {"1": 1}) for name in DATASETS]
    return datasets.unmapped_labels(datasets.union_corpora(parts))


_QUERIES = {
    "s1_corpus": q_s1_corpus,
    "s1_landed_corpus": q_s1_landed_corpus,
    "s3_csv_corpus": q_s3_csv_corpus,
    "s9_flat_documents": q_s9_flat_documents,
    "s10_csv_report": q_s10_csv_report,
    "m2_row_options": q_m2_row_options,
    "j5_backends": q_j5_backends,
    "a24_fitted_values": q_a24_fitted_values,
    "a27_split_sizes": q_a27_split_sizes,
    "a27_inventory": q_a27_inventory,
    "p2_unmapped_labels": q_p2_unmapped_labels,
    "a1_dataset_stats": q_a1_dataset_stats,
    "a2_dataset_comparison": q_a2_dataset_comparison,
    "a3_class_distribution": q_a3_class_distribution,
    "a4_class_share": q_a4_class_share,
    "a5_length_box": q_a5_length_box,
    "a7_max_length": q_a7_max_length,
    "p11_preview": q_p11_preview,
    "x1_balanced_sample": q_x1_balanced_sample,
    "x2_simple_sample": q_x2_simple_sample,
    "x4_balanced_examples": q_x4_balanced_examples,
    "x5_few_shot_examples": q_x5_few_shot_examples,
    "j1_example_pool": q_j1_example_pool,
    "x6_holdout_split": q_x6_holdout_split,
    "x7_stratified_split": q_x7_stratified_split,
    "x8_validation_split": q_x8_validation_split,
    "f1_truncate": q_f1_truncate,
    "f2_f5_prompts": q_f2_f5_prompts,
    "f3_few_shot_prompts": q_f3_few_shot_prompts,
    "f4_example_block": q_f4_example_block,
    "f6_step_prompts": q_f6_step_prompts,
    "f10_classification_prompt": q_f10_classification_prompt,
    "f20_backend_names": q_f20_backend_names,
    "j6_resolved_backends": q_j6_resolved_backends,
    "f7_alternative_prompts": q_f7_alternative_prompts,
    "f11_chat_messages": q_f11_chat_messages,
    "f12_parse_conversations": q_f12_parse_conversations,
    "m6_grid": q_m6_grid,
    "m5_isolation": q_m5_isolation,
    "a8_confusion_matrix": q_a8_confusion_matrix,
    "m1_score_corpus": q_m1_score_corpus,
    "p6_error_analysis": q_p6_error_analysis,
    "a28_first_false_positive": q_a28_first_false_positive,
    "p7_report": q_p7_report,
    "l1_report_ranked": q_l1_report_ranked,
    "a14_by_strategy": q_a14_by_strategy,
    "a15_by_model": q_a15_by_model,
    "a16_grouped_means": q_a16_grouped_means,
    "a17_best_strategy_per_model": q_a17_best_strategy_per_model,
    "a17_best_model_per_strategy": q_a17_best_model_per_strategy,
    "a18_best_overall": q_a18_best_overall,
    "a20_compare_models": q_a20_compare_models,
    "a21_heatmap_strategy": q_a21_heatmap_strategy,
    "a22_heatmap_dataset": q_a22_heatmap_dataset,
    "a23_statistical_analysis": q_a23_statistical_analysis,
    "a24_parameter_trend": q_a24_parameter_trend,
    "a25_parameter_bins": q_a25_parameter_bins,
    "a6_f1_box_by_strategy": q_a6_f1_box_by_strategy,
    "a6_f1_box_by_model": q_a6_f1_box_by_model,
    "a6_f1_box_by_dataset": q_a6_f1_box_by_dataset,
    "a26_distinct_values": q_a26_distinct_values,
    "a27_counts": q_a27_counts,
    "f13_f18_model_parameters": q_f13_f18_model_parameters,
    "j4_pending_cells": q_j4_pending_cells,
    "l4_latest_results": q_l4_latest_results,
    "m12_report_models": q_m12_report_models,
    "m7_trained_baseline": q_m7_trained_baseline,
}


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the whole benchmark grid (sample -> prompts -> rule models
    -> parse -> metrics) on sf0.001."""
    return q_m6_grid(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES) | (_llm.QUERIES if _llm else {})


def oracle_sql() -> dict[str, str]:
    from oracle_queries import ORACLE
    return dict(ORACLE) | (_llm.ORACLE if _llm else {})
