"""The oracle SQL (DuckDB) of every registered query, by key."""

from __future__ import annotations

import re

from oracle_sql import (ALT_NAMES, R, block_cte, corpus_cte, counters, fill, grid_ctes, key, lit, metric_select,
                        parse, prompt_expr, rule_response, sample_ctes, single_prompt, trunc)
from textbench.functions.prompts import (
    ALTERNATIVE_PROMPTS, CHAIN_OF_THOUGHT_STEPS_TEMPLATE, CHAIN_OF_THOUGHT_TEMPLATE, SYSTEM_PROMPT, ZERO_SHOT_TEMPLATE)
from textbench.testbed import RULE_SQL, STRATEGIES, TABLE_DATASETS

SAMPLE = 100
SEED = 42
NEX = 3
M = 2000
DS = list(TABLE_DATASETS)

W = f"WITH {corpus_cte()}"
WS = W + sample_ctes(SAMPLE, SEED, NEX)
G = grid_ctes(SAMPLE, SEED, NEX, M, STRATEGIES, DS)


def r(x: str) -> str:
    return f"round({x}, {R})"


def _stats_cte() -> str:
    return (f"s AS (SELECT dataset, CAST(count(*) AS BIGINT) AS total_samples, "
            f"CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS fake_samples, "
            f"CAST(count(*) FILTER (WHERE label = 0) AS BIGINT) AS true_samples, "
            f"avg(length(text)) AS avg_text_length, CAST(min(length(text)) AS BIGINT) AS min_text_length, "
            f"CAST(max(length(text)) AS BIGINT) AS max_text_length FROM corpus GROUP BY dataset)")


STAT_NAMES = ["total_samples", "fake_samples", "true_samples", "avg_text_length", "min_text_length",
              "max_text_length"]

ORACLE: dict[str, str] = {}

ORACLE["s1_corpus"] = f"{W} SELECT dataset, doc_id, label, CAST(length(text) AS BIGINT) AS text_length FROM corpus"

ORACLE["a1_dataset_stats"] = f"""{W}, {_stats_cte()}
SELECT dataset, total_samples, fake_samples, true_samples, {r('avg_text_length')} AS avg_text_length,
       min_text_length, max_text_length FROM s"""

_unp = " UNION ALL ".join(f"SELECT dataset, {lit(c)} AS stat, CAST({c} AS DOUBLE) AS value FROM s" for c in STAT_NAMES)
_piv = ", ".join(f"{r(f'max(value) FILTER (WHERE dataset = {lit(d)})')} AS {d}" for d in DS)
ORACLE["a2_dataset_comparison"] = f"""{W}, {_stats_cte()}, l AS ({_unp})
SELECT stat, {_piv} FROM l GROUP BY stat"""

ORACLE["a3_class_distribution"] = f"""{W}
SELECT dataset, label, CAST(count(*) AS BIGINT) AS n FROM corpus WHERE label IS NOT NULL GROUP BY dataset, label"""

ORACLE["a4_class_share"] = f"""{W}, c AS (
SELECT dataset, label, CAST(count(*) AS BIGINT) AS n FROM corpus WHERE label IS NOT NULL GROUP BY dataset, label)
SELECT dataset, label, n,
       {r('CAST(n AS DOUBLE) * 100.0 / CAST(sum(n) OVER (PARTITION BY dataset) AS DOUBLE)')} AS share_pct FROM c"""


def _box(src: str, value: str, by: list[str], rounded: bool) -> str:
    b = ", ".join(by)
    inside = f"v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)"
    f = (lambda x: r(x)) if rounded else (lambda x: x)
    return f"""vals AS (SELECT {b}, {value} AS v FROM {src}),
q AS (SELECT {b}, CAST(count(v) AS BIGINT) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
             quantile_cont(v, 0.75) AS q3 FROM vals WHERE v IS NOT NULL GROUP BY {b})
SELECT {', '.join('q.' + c for c in by)}, q.n, {f('q.q1')} AS q1, {f('q.median')} AS median, {f('q.q3')} AS q3,
       {f(f'least(q.q1, CAST(min(v) FILTER (WHERE {inside}) AS DOUBLE))')} AS whisker_low,
       {f(f'greatest(q.q3, CAST(max(v) FILTER (WHERE {inside}) AS DOUBLE))')} AS whisker_high,
       CAST(count(*) FILTER (WHERE NOT ({inside})) AS BIGINT) AS n_outliers
FROM vals JOIN q USING ({b}) WHERE v IS NOT NULL
GROUP BY {', '.join('q.' + c for c in by)}, q.n, q.q1, q.median, q.q3"""


ORACLE["a5_length_box"] = f"""{W},
lab AS (SELECT * FROM corpus WHERE label IS NOT NULL),
{_box('lab', 'CAST(length(text) AS BIGINT)', ['dataset', 'label'], False)}"""

ORACLE["a7_max_length"] = f"{W} SELECT dataset, CAST(max(length(text)) AS BIGINT) AS max_text_length FROM corpus GROUP BY dataset"

ORACLE["p11_preview"] = f"""{W}
SELECT dataset, doc_id, md5(substr(text, 1, 500)) AS preview_md5, CAST(length(substr(text, 1, 500)) AS INTEGER) AS preview_len
FROM corpus"""

# --------------------------------------------------------------------------- sampling

ORACLE["x1_balanced_sample"] = f"{WS} SELECT dataset, doc_id, label FROM test"

ORACLE["x2_simple_sample"] = f"""{W}
SELECT dataset, doc_id, label FROM corpus WHERE label IN (0, 1)
QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY {key(SEED)}, doc_id) <= {SAMPLE}"""

ORACLE["x4_balanced_examples"] = f"""{WS},
b AS (SELECT * FROM pool WHERE label IN (0, 1)
      QUALIFY row_number() OVER (PARTITION BY dataset, label ORDER BY {key(SEED)}, doc_id) <= {max(1, NEX // 2)})
SELECT dataset, doc_id, label,
       CAST(row_number() OVER (PARTITION BY dataset ORDER BY {key(SEED)}, doc_id) AS INTEGER) AS example_rank FROM b"""

ORACLE["x5_few_shot_examples"] = f"{WS} SELECT dataset, doc_id, label, CAST(example_rank AS INTEGER) AS example_rank FROM ex"

ORACLE["j1_example_pool"] = f"{WS} SELECT dataset, CAST(count(*) AS BIGINT) AS pool_rows FROM pool GROUP BY dataset"


def _strat(src: str, seed_prefix: str, test_size: float = 0.2) -> str:
    """CTEs st_test / st_train: stratified split of ``src`` (labelled rows)."""
    k = f"md5(concat({lit(seed_prefix)}, '|', CAST(doc_id AS VARCHAR)))"
    return f"""st_src AS (SELECT * FROM {src} WHERE label IN (0, 1)),
st_cc AS (SELECT dataset, label, CAST(count(*) AS BIGINT) AS n_class FROM st_src GROUP BY dataset, label),
st_q0 AS (SELECT *, CAST(sum(n_class) OVER (PARTITION BY dataset) AS BIGINT) AS n FROM st_cc),
st_q1 AS (SELECT *, CAST(ceil(CAST({test_size!r} AS DOUBLE) * CAST(n AS DOUBLE)) AS BIGINT) AS n_test FROM st_q0),
st_q2 AS (SELECT *, CAST(n_class AS DOUBLE) / CAST(n AS DOUBLE) * CAST(n_test AS DOUBLE) AS cont FROM st_q1),
st_q3 AS (SELECT *, floor(cont) AS fl FROM st_q2),
st_q4 AS (SELECT *, n_test - sum(fl) OVER (PARTITION BY dataset) AS left_over,
                 row_number() OVER (PARTITION BY dataset ORDER BY cont - fl DESC, label) AS rem_rank FROM st_q3),
st_quota AS (SELECT dataset, label, CAST(fl + CASE WHEN rem_rank <= left_over THEN 1 ELSE 0 END AS BIGINT) AS quota
             FROM st_q4),
st_ranked AS (SELECT s.*, q.quota, row_number() OVER (PARTITION BY s.dataset, s.label ORDER BY {k}, s.doc_id) AS rk
              FROM st_src s JOIN st_quota q ON s.dataset = q.dataset AND s.label = q.label),
st_test AS (SELECT * EXCLUDE (quota, rk) FROM st_ranked WHERE rk <= quota),
st_train AS (SELECT * EXCLUDE (quota, rk) FROM st_ranked WHERE rk > quota)"""


ORACLE["x7_stratified_split"] = f"""{W}, {_strat('corpus', str(SEED))}
SELECT dataset, doc_id, label, 'test' AS split FROM st_test
UNION ALL SELECT dataset, doc_id, label, 'train' AS split FROM st_train"""


def _holdout() -> str:
    """CTEs ho_test / ho_train (the supervised baseline's hold-out split)."""
    half = SAMPLE // 2
    return f"""{_strat('corpus', str(SEED))},
ho_cc AS (SELECT dataset, sum(CASE WHEN label IN (0, 1) THEN 1 ELSE 0 END) AS n,
                 sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS c0, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS c1
          FROM corpus GROUP BY dataset),
ho_mode AS (SELECT dataset, CASE WHEN {SAMPLE} < n THEN
              (CASE WHEN c0 >= {half} AND c1 >= {half} THEN 'balanced' ELSE 'simple' END) ELSE 'stratified' END AS mode
            FROM ho_cc),
ho_keyed AS (SELECT *, {key(SEED)} AS k FROM corpus WHERE label IN (0, 1)),
ho_bal AS (SELECT * FROM ho_keyed QUALIFY row_number() OVER (PARTITION BY dataset, label ORDER BY k, doc_id) <= {half}),
ho_simple AS (SELECT * FROM ho_keyed QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY k, doc_id) <= {SAMPLE}),
ho_test AS (
  SELECT b.dataset, b.doc_id, b.text, b.label FROM ho_bal b JOIN ho_mode m ON b.dataset = m.dataset AND m.mode = 'balanced'
  UNION ALL
  SELECT s.dataset, s.doc_id, s.text, s.label FROM ho_simple s JOIN ho_mode m ON s.dataset = m.dataset AND m.mode = 'simple'
  UNION ALL
  SELECT t.dataset, t.doc_id, t.text, t.label FROM st_test t JOIN ho_mode m ON t.dataset = m.dataset AND m.mode = 'stratified'),
ho_train AS (
  SELECT c.dataset, c.doc_id, c.text, c.label FROM corpus c JOIN ho_mode m ON c.dataset = m.dataset AND m.mode <> 'stratified'
  WHERE c.label IN (0, 1) AND NOT EXISTS (SELECT 1 FROM ho_test t WHERE t.dataset = c.dataset AND t.doc_id = c.doc_id)
  UNION ALL
  SELECT t.dataset, t.doc_id, t.text, t.label FROM st_train t JOIN ho_mode m ON t.dataset = m.dataset AND m.mode = 'stratified')"""


ORACLE["x6_holdout_split"] = f"""{W}, {_holdout()}
SELECT dataset, doc_id, label, 'test' AS split FROM ho_test
UNION ALL SELECT dataset, doc_id, label, 'train' AS split FROM ho_train"""

_val = _strat("ho_train", f"{SEED}|validation").replace("st_", "va_")
ORACLE["x8_validation_split"] = f"""{W}, {_holdout()}, {_val}
SELECT dataset, doc_id, label, 'validation' AS split FROM va_test
UNION ALL SELECT dataset, doc_id, label, 'train' AS split FROM va_train"""

# --------------------------------------------------------------------------- prompts

_tcols = ", ".join(f"CAST(length({trunc('text', m)}) AS INTEGER) AS len_{m}, md5({trunc('text', m)}) AS md5_{m}"
                   for m in (10, 100, 1000, 2000))
ORACLE["f1_truncate"] = f"SELECT doc_id, {_tcols} FROM documents"

ORACLE["f2_f5_prompts"] = f"""{W}
SELECT dataset, doc_id, 'zero_shot' AS strategy, md5({single_prompt(ZERO_SHOT_TEMPLATE)}) AS prompt_md5,
       CAST(length({single_prompt(ZERO_SHOT_TEMPLATE)}) AS INTEGER) AS prompt_len FROM corpus
UNION ALL
SELECT dataset, doc_id, 'chain_of_thought', md5({single_prompt(CHAIN_OF_THOUGHT_TEMPLATE)}),
       CAST(length({single_prompt(CHAIN_OF_THOUGHT_TEMPLATE)}) AS INTEGER) FROM corpus"""

ORACLE["f3_few_shot_prompts"] = f"""{WS}{block_cte(M)}
SELECT t.dataset, t.doc_id, md5({prompt_expr("'few_shot'", 't.text', 'b.examples_text', M)}) AS prompt_md5,
       CAST(length({prompt_expr("'few_shot'", 't.text', 'b.examples_text', M)}) AS INTEGER) AS prompt_len
FROM test t JOIN block b ON t.dataset = b.dataset"""

ORACLE["f4_example_block"] = f"""{WS}{block_cte(M)}
SELECT dataset, md5(examples_text) AS block_md5, CAST(length(examples_text) AS INTEGER) AS block_len,
       CAST(n_examples AS BIGINT) AS n_examples FROM block"""

_acols = ", ".join(f"md5({fill(ALTERNATIVE_PROMPTS[n], text=trunc('text', M))}) AS {n}_md5" for n in ALT_NAMES)
ORACLE["f7_alternative_prompts"] = f"SELECT doc_id, {_acols} FROM documents"

ORACLE["f11_chat_messages"] = f"""{W}
SELECT dataset, doc_id, CAST(2 AS INTEGER) AS n_messages, 'system' AS role_0, 'user' AS role_1,
       md5({lit(SYSTEM_PROMPT)}) AS content_0_md5, md5({single_prompt(ZERO_SHOT_TEMPLATE)}) AS content_1_md5
FROM corpus"""

ORACLE["f6_step_prompts"] = f"""
SELECT doc_id, md5({single_prompt(CHAIN_OF_THOUGHT_STEPS_TEMPLATE)}) AS prompt_md5,
       CAST(length({single_prompt(CHAIN_OF_THOUGHT_STEPS_TEMPLATE)}) AS INTEGER) AS prompt_len FROM documents"""

ORACLE["f10_classification_prompt"] = f"""{WS}{block_cte(M)}
SELECT c.dataset, c.doc_id, md5({prompt_expr("'few_shot'", 'c.text', 'b.examples_text', M)}) AS prompt_md5,
       CAST(length({prompt_expr("'few_shot'", 'c.text', 'b.examples_text', M)}) AS INTEGER) AS prompt_len
FROM corpus c JOIN block b ON c.dataset = b.dataset"""

ORACLE["f20_backend_names"] = """
SELECT doc_id, lower(CASE doc_id % 3 WHEN 0 THEN 'hf.co/Hub/' || upper(source) WHEN 1 THEN 'hf.co/Org/' || upper(source)
                     ELSE 'Local-' || upper(source) || ':' || upper(lang) END) AS backend_name FROM documents"""

ORACLE["j6_resolved_backends"] = """
SELECT source AS model, 'hf.co/Org/' || source || ':latest' AS backend_name,
       CASE WHEN source LIKE '%1%' THEN 'https://huggingface.co/org/' || upper(source)
            ELSE 'hf.co/Org/' || source || ':latest' END AS resolved
FROM (SELECT DISTINCT source FROM documents)"""

ORACLE["s1_landed_corpus"] = """
SELECT 'landed' AS dataset, d.doc_id, CAST(1 - l.quality AS INTEGER) AS label, md5(d.text) AS text_md5
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""

ORACLE["p2_unmapped_labels"] = " UNION ALL ".join(
    f"SELECT {lit(d)} AS dataset, CAST({d} AS VARCHAR) AS label_raw, CAST(count(*) AS BIGINT) AS n FROM labels "
    f"WHERE {d} IS NULL OR {d} <> 1 GROUP BY {d}" for d in DS)

# --------------------------------------------------------------------------- parsing, scoring, metrics

ORACLE["f12_parse_conversations"] = f"""
SELECT conv_id, turn, role, CAST({parse('text')} AS INTEGER) AS prediction FROM conversations"""

_gcols = ["model", "strategy", "dataset", "error", "n", "accuracy", "precision", "recall", "f1_score",
          "precision_macro", "recall_macro", "f1_macro", "invalid_predictions", "invalid_rate", "true_negatives",
          "false_positives", "false_negatives", "true_positives", "sample_size"]
ORACLE["m6_grid"] = f"""{G}
SELECT {', '.join(_gcols)}, {r('avg_inference_time')} AS avg_inference_time,
       {r('total_inference_time')} AS total_inference_time FROM grid"""

ORACLE["a8_confusion_matrix"] = f"""{G}
SELECT model, strategy, dataset,
       [[true_negatives, false_positives], [false_negatives, true_positives]] AS confusion_matrix
FROM grid WHERE error IS NULL"""

_models = ", ".join(f"({lit(m)})" for m in RULE_SQL)
_CP = f"""{W},
models AS (SELECT * FROM (VALUES {_models}) AS t(model)),
pr AS (SELECT c.dataset, c.doc_id, c.label, m.model, {single_prompt(ZERO_SHOT_TEMPLATE, 'c.text')} AS prompt
       FROM corpus c CROSS JOIN models m),
sc AS (SELECT *, {rule_response()} AS response FROM pr),
preds AS (SELECT *, CAST(length(prompt) AS DOUBLE) / CAST(10000.0 AS DOUBLE) AS inference_time,
                 {parse('response')} AS prediction FROM sc)"""

_mc = metric_select()
_mlist = ", ".join(f"{v} AS {k}" for k, v in _mc.items())
ORACLE["m1_score_corpus"] = f"""{_CP},
cnt AS (SELECT model, dataset, {counters()}, avg(inference_time) AS t FROM preds GROUP BY model, dataset)
SELECT model, dataset, n, {_mlist}, {r('t')} AS avg_inference_time FROM cnt"""

ORACLE["p6_error_analysis"] = f"""{_CP}
SELECT model, dataset, CAST(count(*) AS BIGINT) AS n,
       CAST(count(*) FILTER (WHERE NOT coalesce(label = prediction, false)) AS BIGINT) AS n_errors,
       {r('CAST(count(*) FILTER (WHERE NOT coalesce(label = prediction, false)) AS DOUBLE) / CAST(count(*) AS DOUBLE)')} AS error_rate,
       CAST(count(*) FILTER (WHERE label = 0 AND prediction = 1) AS BIGINT) AS n_false_positives,
       CAST(count(*) FILTER (WHERE label = 1 AND prediction = 0) AS BIGINT) AS n_false_negatives,
       CAST(count(*) FILTER (WHERE NOT coalesce(prediction IN (0, 1), false)) AS BIGINT) AS n_invalid
FROM preds GROUP BY model, dataset"""

ORACLE["a28_first_false_positive"] = f"""{_CP}
SELECT model, dataset, min(doc_id) AS doc_id FROM preds WHERE label = 0 AND prediction = 1 GROUP BY model, dataset"""

# --------------------------------------------------------------------------- report and analysis

ORACLE["p7_report"] = f"""{G}
SELECT model, strategy, dataset, accuracy, precision, recall, f1_score, {r('avg_inference_time')} AS avg_inference_time,
       vram_usage_gb, invalid_rate, error FROM report"""

ORACLE["l1_report_ranked"] = f"""{G}
SELECT model, strategy, dataset, f1_score,
       CAST(row_number() OVER (ORDER BY f1_score DESC NULLS LAST, model, strategy, dataset) AS INTEGER) AS rank
FROM report"""

_q4 = ", ".join(f"{r(f'avg({c})')} AS {c}" for c in ("accuracy", "precision", "recall", "f1_score"))
ORACLE["a14_by_strategy"] = f"{G} SELECT strategy, {_q4} FROM report GROUP BY strategy"
ORACLE["a15_by_model"] = f"{G} SELECT model, {_q4} FROM report GROUP BY model"

_gm = " UNION ALL ".join(
    f"SELECT {lit(d)} AS dimension, {d} AS value, {r('avg(f1_score)')} AS f1_score, {r('avg(accuracy)')} AS accuracy, "
    f"{r('avg(avg_inference_time)')} AS avg_inference_time FROM report GROUP BY {d}"
    for d in ("model", "strategy", "dataset"))
ORACLE["a16_grouped_means"] = f"{G} {_gm}"


def _best(k: str, other: str, rest: list[str]) -> str:
    order = ", ".join(rest)
    return f"""{G},
rk AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY f1_score DESC NULLS LAST, {order}) AS rn FROM report),
best AS (SELECT {k}, {other} AS best_{other} FROM rk WHERE rn = 1 AND f1_score IS NOT NULL),
mean AS (SELECT {k}, avg(f1_score) AS mean_f1_score FROM report GROUP BY {k})
SELECT mean.{k}, {r('mean.mean_f1_score')} AS mean_f1_score, best.best_{other}
FROM mean LEFT JOIN best ON mean.{k} = best.{k}"""


ORACLE["a17_best_strategy_per_model"] = _best("model", "strategy", ["strategy", "dataset"])
ORACLE["a17_best_model_per_strategy"] = _best("strategy", "model", ["model", "dataset"])

ORACLE["a18_best_overall"] = f"""{G}
SELECT model, strategy, dataset, f1_score FROM report WHERE f1_score IS NOT NULL
ORDER BY f1_score DESC, model, strategy, dataset LIMIT 1"""

_cm = ", ".join(
    f"{r(f'avg(f1_score) FILTER (WHERE strategy = {lit(s)} AND dataset = {lit(d)})')} AS \"{s}|{d}\""
    for s in STRATEGIES for d in DS)
ORACLE["a20_compare_models"] = f"{G} SELECT model, {_cm} FROM report WHERE error IS NULL GROUP BY model"

_short = "string_split(model, '/')[-1]"
_hs = ", ".join(f"{r(f'avg(f1_score) FILTER (WHERE strategy = {lit(s)})')} AS {s}" for s in STRATEGIES)
ORACLE["a21_heatmap_strategy"] = f"{G} SELECT {_short} AS short_model, {_hs} FROM report GROUP BY {_short}"
_hd = ", ".join(f"{r(f'avg(f1_score) FILTER (WHERE dataset = {lit(d)})')} AS {d}" for d in DS)
ORACLE["a22_heatmap_dataset"] = f"{G} SELECT {_short} AS short_model, {_hd} FROM report GROUP BY {_short}"

ORACLE["a23_statistical_analysis"] = f"""{G}
SELECT model || '_' || strategy AS model_strategy, {r('avg(f1_score)')} AS mean, {r('stddev_pop(f1_score)')} AS std,
       {r('min(f1_score)')} AS min, {r('max(f1_score)')} AS max, CAST(count(f1_score) AS BIGINT) AS n
FROM report WHERE error IS NULL GROUP BY model, strategy"""

_params = "TRY_CAST(nullif(regexp_extract(model, '(\\d+\\.?\\d*)[Bb]', 1), '') AS DOUBLE)"
_tr = " UNION ALL ".join(
    f"SELECT {lit(m)} AS metric, {r(f'regr_slope({m}, p)')} AS slope, {r(f'regr_intercept({m}, p)')} AS intercept, "
    f"CAST(regr_count({m}, p) AS BIGINT) AS n FROM rp"
    for m in ("f1_score", "accuracy", "avg_inference_time"))
ORACLE["a24_parameter_trend"] = f"""{G},
rp AS (SELECT *, {_params} AS p FROM report WHERE {_params} IS NOT NULL)
{_tr}"""

_bin = ("CASE WHEN p > 0.0 AND p <= 2.0 THEN '< 2B' WHEN p > 2.0 AND p <= 5.0 THEN '2-5B' "
        "WHEN p > 5.0 AND p <= 10.0 THEN '5-10B' WHEN p > 10.0 THEN '> 10B' END")
ORACLE["a25_parameter_bins"] = f"""{G},
rp AS (SELECT *, {_params} AS p FROM report WHERE {_params} IS NOT NULL),
bn AS (SELECT *, {_bin} AS param_range FROM rp)
SELECT param_range, {r('avg(f1_score)')} AS f1_score, CAST(count(*) AS BIGINT) AS n FROM bn
WHERE param_range IS NOT NULL GROUP BY param_range"""

ORACLE["a6_f1_box_by_strategy"] = f"""{G},
ok AS (SELECT * FROM report WHERE error IS NULL),
{_box('ok', 'f1_score', ['strategy'], True)}"""

for _dim in ("model", "dataset"):
    ORACLE[f"a6_f1_box_by_{_dim}"] = f"""{G},
ok AS (SELECT * FROM report WHERE error IS NULL),
{_box('ok', 'f1_score', [_dim], True)}"""

ORACLE["a26_distinct_values"] = f"""{G}
SELECT array_to_string(list_sort(list_distinct(list(model))), ', ') AS models,
       array_to_string(list_sort(list_distinct(list(strategy))), ', ') AS strategys,
       array_to_string(list_sort(list_distinct(list(dataset))), ', ') AS datasets FROM report"""

ORACLE["a27_counts"] = f"""{G}
SELECT CAST(count(*) AS BIGINT) AS experiments, CAST(count(*) FILTER (WHERE error IS NULL) AS BIGINT) AS successful,
       CAST(count(*) FILTER (WHERE error IS NOT NULL) AS BIGINT) AS failed FROM report"""

ORACLE["f13_f18_model_parameters"] = f"""{G},
ms AS (SELECT DISTINCT model FROM report),
mp AS (SELECT model, {_params} AS p FROM ms)
SELECT model, p AS num_parameters, {_bin} AS param_range, {_short} AS short_model,
       replace(model, '/', '_') || '_zero_shot_quality' AS zero_shot_key FROM mp"""

ORACLE["m5_isolation"] = f"""{G}
SELECT model, strategy, dataset, error, n, f1_score FROM grid WHERE model = 'rules/hash-4b'
UNION ALL SELECT 'rules/broken-3B', strategy, dataset, 'RuntimeError: the back end cannot be opened', NULL, NULL
FROM grid WHERE model = 'rules/hash-4b'"""

ORACLE["l4_latest_results"] = f"""{G}
SELECT model, strategy, dataset, error, sample_size + CASE WHEN strategy = 'zero_shot' THEN 1 ELSE 0 END AS sample_size,
       f1_score, CASE WHEN strategy = 'zero_shot' THEN '2026-01-02T00:00:00.000000'
                      ELSE '2026-01-01T00:00:00.000000' END AS timestamp
FROM grid WHERE error IS NULL"""

ORACLE["m12_report_models"] = f"""{G}
SELECT model, strategy, dataset, f1_score, CAST(NULL AS VARCHAR) AS backend_name, {_params} AS num_parameters
FROM grid WHERE error IS NULL"""

_base = "('spark-ml/tfidf-logreg'), ('spark-ml/tfidf-naive-bayes')"
ORACLE["m7_trained_baseline"] = f"""{W}, {_holdout()},
t AS (SELECT dataset, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE label = 0) AS BIGINT) AS actual_negatives,
             CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS actual_positives FROM ho_test GROUP BY dataset)
SELECT m.model, 'fine_tuned' AS strategy, t.dataset, CAST(NULL AS VARCHAR) AS error, t.n, t.actual_negatives,
       t.actual_positives FROM t, (VALUES {_base}) AS m(model)"""

ORACLE["a24_fitted_values"] = f"""{G},
rp AS (SELECT *, {_params} AS p FROM report WHERE {_params} IS NOT NULL)
""" + " UNION ALL ".join(
    f"SELECT model, strategy, dataset, {lit(m)} AS metric, p AS num_parameters, {r(m)} AS value, "
    f"{r(f'(SELECT regr_slope({m}, p) FROM rp) * p + (SELECT regr_intercept({m}, p) FROM rp)')} AS fitted FROM rp"
    for m in ("f1_score", "accuracy", "avg_inference_time"))

ORACLE["a27_split_sizes"] = f"""WITH split_rows AS ({ORACLE["x6_holdout_split"]})
SELECT dataset, split, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE label = 0) AS BIGINT) AS negatives,
       CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS positives FROM split_rows GROUP BY dataset, split"""

ORACLE["a27_inventory"] = f"""{G}
SELECT CAST(count(*) AS BIGINT) AS files, CAST(count(*) AS BIGINT) AS loaded,
       CAST(count(*) FILTER (WHERE error IS NULL) AS BIGINT) AS successful,
       CAST(count(*) FILTER (WHERE error IS NOT NULL) AS BIGINT) AS failed, CAST(0 AS BIGINT) AS undecodable FROM grid"""

ORACLE["s9_flat_documents"] = f"""{G}
SELECT replace(model, '/', '_') || '_' || strategy || '_' || dataset || '.json' AS file, model, strategy, dataset, error,
       sample_size, f1_score, true_positives FROM grid"""

ORACLE["s10_csv_report"] = f"{G} SELECT model, strategy, dataset, error, f1_score, invalid_rate FROM report"

ORACLE["s3_csv_corpus"] = """
SELECT 'landed' AS dataset, d.doc_id, CAST(l.toxic AS INTEGER) AS label, md5(d.text) AS text_md5
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""

ORACLE["j5_backends"] = """
SELECT source AS model, CASE WHEN source LIKE '%1%' THEN 'hub/' || source END AS backend_name,
       CASE WHEN source NOT LIKE '%1%' THEN 'model ''' || source || ''' is not in the back-end registry' END AS error
FROM (SELECT DISTINCT source FROM documents)"""

_tok = "CASE strategy WHEN 'zero_shot' THEN 4 WHEN 'few_shot' THEN 16 ELSE 256 END"
_heat = "CASE WHEN dataset = 'toxic' THEN 0.9::DOUBLE WHEN m.model = 'rules/options-2B' THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END"
ORACLE["m2_row_options"] = f"""{G},
asked AS (SELECT m.model, strategy, dataset, label, length(prompt) AS n_chars, CAST({_tok} AS INTEGER) AS max_new_tokens,
                 {_heat} AS temperature, prompt_error
          FROM prompts p, (VALUES ('rules/options-2B'), ('rules/options-py-3B')) AS m(model)
          WHERE p.model = 'rules/parity-1.5B')
SELECT model, strategy, dataset, CASE WHEN prompt_error IS NULL THEN max_new_tokens END AS max_new_tokens,
       CASE WHEN prompt_error IS NULL THEN temperature END AS temperature, CAST(count(*) AS BIGINT) AS n,
       CAST(count(*) FILTER (WHERE prompt_error IS NULL AND CASE model WHEN 'rules/options-2B' THEN n_chars % max_new_tokens < 3
                             ELSE n_chars % max_new_tokens < 10 * temperature END) AS BIGINT) AS answered_fake
FROM asked GROUP BY ALL"""

ORACLE["j4_pending_cells"] = f"{G} SELECT model, strategy, dataset FROM grid WHERE error IS NOT NULL"


# the analysis runs over successful experiments only (failed cells are dropped
# before any aggregate): the same SQL over ``okr``, the filtered report
for _k in ['a14_by_strategy', 'a15_by_model', 'a16_grouped_means', 'a17_best_strategy_per_model', 'a17_best_model_per_strategy', 'a18_best_overall', 'a20_compare_models', 'a21_heatmap_strategy', 'a22_heatmap_dataset', 'a23_statistical_analysis', 'a24_parameter_trend', 'a24_fitted_values', 'a25_parameter_bins', 'a26_distinct_values', 'f13_f18_model_parameters']:
    assert ORACLE[_k].startswith(G)
    ORACLE[_k] = G + re.sub(r"\breport\b", "okr", ORACLE[_k][len(G):])
