"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

The oracle states each operator directly in SQL — plain windows where the
Spark side uses bucket cuts, ``string_agg`` where it collects, and so on —
over the same parquet views.  Fragments that must be textually equal on
both sides (templates, keywords, rule answers) come from the package's
fixed values so that a typo cannot hide in only one of them.
"""

from __future__ import annotations

from textbench.functions.parsing import FAKE_KEYWORDS, TRUE_KEYWORDS
from textbench.functions.prompts import (
    ALTERNATIVE_PROMPTS, CHAIN_OF_THOUGHT_TEMPLATE, FAKE_LABEL_TEXT, FEW_SHOT_EXAMPLE_TEMPLATE, FEW_SHOT_TEMPLATE,
    SYSTEM_PROMPT, TRUE_LABEL_TEXT, ZERO_SHOT_TEMPLATE, _pieces)
from textbench.plans.grid import EMPTY_SAMPLE_ERROR, NO_EXAMPLES_ERROR
from textbench.testbed import MODEL_NAMES, RULE_SQL, TABLE_DATASETS

R = 9  # digits kept for averaged values (summation order differs)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fill(template: str, **exprs: str) -> str:
    parts = []
    for p in _pieces(template):
        if isinstance(p, tuple):
            parts.append(f"({exprs[p[1]]})")
        elif p:
            parts.append(lit(p))
    return " || ".join(parts)


def trunc(t: str, m: int) -> str:
    head = f"substr({t}, 1, {m})"
    last = f"(CASE WHEN contains({head}, ' ') THEN length(regexp_extract({head}, '(?s)^(.*) ', 1)) ELSE -1 END)"
    return (f"(CASE WHEN length({t}) <= {m} THEN {t} ELSE "
            f"(CASE WHEN {last} > {m * 0.8!r} THEN substr({head}, 1, {last}) ELSE {head} END) || '...' END)")


def key(seed: int = 42, col: str = "doc_id") -> str:
    return f"md5(concat({lit(str(seed))}, '|', CAST({col} AS VARCHAR)))"


def corpus_cte() -> str:
    parts = []
    for name, cfg in TABLE_DATASETS.items():
        m = " ".join(f"WHEN {lit(str(k))} THEN {int(v)}" for k, v in cfg["label_mapping"].items())
        parts.append(f"SELECT {lit(name)} AS dataset, d.doc_id, d.{cfg['text_column']} AS text, "
                     f"CASE CAST(l.{cfg['label_column']} AS VARCHAR) {m} END AS label "
                     f"FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
    return "corpus AS (" + " UNION ALL ".join(parts) + ")"


def sample_ctes(sample_size: int = 100, seed: int = 42, n_examples: int = 3) -> str:
    k = sample_size // 2
    return f""",
keyed AS (SELECT *, {key(seed)} AS k FROM corpus WHERE label IN (0, 1)),
test AS (SELECT dataset, doc_id, text, label FROM keyed
         QUALIFY row_number() OVER (PARTITION BY dataset, label ORDER BY k, doc_id) <= {k}),
pool AS (SELECT c.* FROM corpus c ANTI JOIN test t ON c.dataset = t.dataset AND c.doc_id = t.doc_id
         WHERE c.label IN (0, 1)),
ex AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY {key(seed)}, doc_id) AS example_rank FROM pool
       QUALIFY example_rank <= {n_examples})"""


def label_text(lab: str) -> str:
    return f"(CASE WHEN {lab} = 0 THEN {lit(TRUE_LABEL_TEXT)} ELSE {lit(FAKE_LABEL_TEXT)} END)"


def example_line(t: str = "text", lab: str = "label", m: int = 2000) -> str:
    return "(" + fill(FEW_SHOT_EXAMPLE_TEMPLATE, text=trunc(t, m // 2), label=label_text(lab)) + " || chr(10))"


def block_cte(m: int = 2000) -> str:
    return f""",
block AS (SELECT dataset, string_agg({example_line('text', 'label', m)}, '' ORDER BY example_rank) AS examples_text,
          count(*) AS n_examples FROM ex GROUP BY dataset)"""


def prompt_expr(strategy: str = "strategy", t: str = "text", ex: str = "examples_text", m: int = 2000) -> str:
    tt = trunc(t, m)
    body = (f"CASE {strategy} WHEN 'zero_shot' THEN {fill(ZERO_SHOT_TEMPLATE, text=tt)} "
            f"WHEN 'few_shot' THEN {fill(FEW_SHOT_TEMPLATE, examples=ex, text=tt)} "
            f"WHEN 'chain_of_thought' THEN {fill(CHAIN_OF_THOUGHT_TEMPLATE, text=tt)} END")
    return f"({lit(SYSTEM_PROMPT + chr(10) + chr(10))} || ({body}))"


def single_prompt(template: str, t: str = "text", m: int = 2000, system: bool = True) -> str:
    body = fill(template, text=trunc(t, m))
    return f"({lit(SYSTEM_PROMPT + chr(10) + chr(10))} || {body})" if system else f"({body})"


def parse(resp: str) -> str:
    low = f"lower({resp})"
    fake = " OR ".join(f"contains({low}, {lit(k)})" for k in FAKE_KEYWORDS)
    true = " OR ".join(f"contains({low}, {lit(k)})" for k in TRUE_KEYWORDS)
    return f"(CASE WHEN {fake} THEN 1 WHEN {true} THEN 0 ELSE -1 END)"


def metric_select(prefix: str = "") -> str:
    tn, fp, fn, tp = (f"{prefix}true_negatives", f"{prefix}false_positives", f"{prefix}false_negatives",
                      f"{prefix}true_positives")
    n, inv = f"{prefix}n", f"{prefix}invalid_predictions"

    def ratio(num, den):
        return f"(CASE WHEN ({den}) > 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) ELSE 0.0 END)"
    p1, r1, f1 = ratio(tp, f"{tp} + {fp}"), ratio(tp, f"{tp} + {fn}"), ratio(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}")
    p0, r0, f0 = ratio(tn, f"{tn} + {fn}"), ratio(tn, f"{tn} + {fp}"), ratio(f"2 * {tn}", f"2 * {tn} + {fn} + {fp}")
    has0, has1 = f"({tn} + {fp} + {fn} > 0)", f"({tp} + {fp} + {fn} > 0)"
    ncls = f"(CAST({has0} AS INTEGER) + CAST({has1} AS INTEGER))"

    def macro(a, b):
        return (f"(CASE WHEN {ncls} > 0 THEN ((CASE WHEN {has0} THEN {a} ELSE 0.0 END) + "
                f"(CASE WHEN {has1} THEN {b} ELSE 0.0 END)) / {ncls} ELSE 0.0 END)")
    return {
        "accuracy": ratio(f"{tp} + {tn}", n), "precision": p1, "recall": r1, "f1_score": f1,
        "precision_macro": macro(p0, p1), "recall_macro": macro(r0, r1), "f1_macro": macro(f0, f1),
        "invalid_predictions": inv, "invalid_rate": ratio(inv, n),
        "true_negatives": tn, "false_positives": fp, "false_negatives": fn, "true_positives": tp,
    }


def counters(label: str = "label", pred: str = "prediction") -> str:
    clean = f"(CASE WHEN coalesce({pred} IN (0, 1), false) THEN {pred} ELSE 1 - {label} END)"
    return (f"CAST(count(*) AS BIGINT) AS n, "
            f"CAST(count(*) FILTER (WHERE {label} = 0 AND {clean} = 0) AS BIGINT) AS true_negatives, "
            f"CAST(count(*) FILTER (WHERE {label} = 0 AND {clean} = 1) AS BIGINT) AS false_positives, "
            f"CAST(count(*) FILTER (WHERE {label} = 1 AND {clean} = 0) AS BIGINT) AS false_negatives, "
            f"CAST(count(*) FILTER (WHERE {label} = 1 AND {clean} = 1) AS BIGINT) AS true_positives, "
            f"CAST(count(*) FILTER (WHERE NOT coalesce({pred} IN (0, 1), false)) AS BIGINT) AS invalid_predictions")


def rule_response(model: str = "model") -> str:
    branches = " ".join(f"WHEN {model} = {lit(name)} THEN ({sql})" for name, sql in RULE_SQL.items())
    return f"(CASE {branches} END)"


def grid_ctes(sample_size: int = 100, seed: int = 42, n_examples: int = 3, m: int = 2000,
              strategies=("zero_shot", "few_shot", "chain_of_thought"), datasets=None) -> str:
    datasets = list(datasets or TABLE_DATASETS)
    cells = ", ".join(f"({lit(a)}, {lit(b)}, {lit(c)})" for a in MODEL_NAMES for b in strategies for c in datasets)
    known = ", ".join(lit(x) for x in RULE_SQL)
    mcols = metric_select()
    metric_list = ",\n       ".join(f"CASE WHEN error IS NULL THEN {v} END AS {k}" for k, v in mcols.items())
    return f"""WITH {corpus_cte()}{sample_ctes(sample_size, seed, n_examples)}{block_cte(m)},
cells AS (SELECT * FROM (VALUES {cells}) AS t(model, strategy, dataset)),
prompts AS (
  SELECT c.model, c.strategy, c.dataset, t.doc_id, t.label,
         {prompt_expr('c.strategy', 't.text', 'b.examples_text', m)} AS prompt,
         CASE WHEN c.strategy = 'few_shot' AND coalesce(b.n_examples, 0) < {n_examples}
              THEN {lit(NO_EXAMPLES_ERROR)} END AS prompt_error
  FROM test t JOIN cells c ON c.dataset = t.dataset LEFT JOIN block b ON b.dataset = t.dataset),
scored AS (
  SELECT *,
    CASE WHEN prompt_error IS NULL THEN {rule_response()} END AS response,
    CASE WHEN prompt_error IS NOT NULL THEN prompt_error
         WHEN model NOT IN ({known}) THEN 'model ''' || model || ''' is not in the back-end registry' END AS error
  FROM prompts),
preds AS (
  SELECT *, CASE WHEN response IS NOT NULL THEN CAST(length(prompt) AS DOUBLE) / CAST(10000.0 AS DOUBLE) END AS inference_time,
         {parse('response')} AS prediction
  FROM scored),
agg AS (
  SELECT model, strategy, dataset, {counters()},
         sum(inference_time) AS total_inference_time, avg(inference_time) AS avg_inference_time,
         max(error) AS row_error
  FROM preds GROUP BY model, strategy, dataset),
cell AS (
  SELECT c.model, c.strategy, c.dataset,
         coalesce(a.row_error, CASE WHEN a.n IS NULL THEN {lit(EMPTY_SAMPLE_ERROR)} END) AS error,
         a.n, a.true_negatives, a.false_positives, a.false_negatives, a.true_positives, a.invalid_predictions,
         a.total_inference_time, a.avg_inference_time
  FROM cells c LEFT JOIN agg a ON a.model = c.model AND a.strategy = c.strategy AND a.dataset = c.dataset),
grid AS (
  SELECT model, strategy, dataset, error, CASE WHEN error IS NULL THEN n END AS n,
       {metric_list},
       CASE WHEN error IS NULL THEN avg_inference_time END AS avg_inference_time,
       CASE WHEN error IS NULL THEN total_inference_time END AS total_inference_time,
       CAST({sample_size} AS BIGINT) AS sample_size
  FROM cell),
report AS (
  SELECT model, strategy, dataset, accuracy, precision, recall, f1_score, avg_inference_time,
         CAST(NULL AS DOUBLE) AS vram_usage_gb, invalid_rate, error
  FROM grid),
okr AS (SELECT * FROM report WHERE error IS NULL)
"""


ALT_NAMES = list(ALTERNATIVE_PROMPTS)
