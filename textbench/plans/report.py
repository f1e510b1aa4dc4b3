"""Consolidated report: flat table, Markdown document, best result.

The Markdown document is built as a DataFrame of lines ``(section, ord,
line)`` from aggregates of the report (one row per experiment, small by
construction) and written as one text file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import display_title, format_metric
from ..sources.results import write_csv
from .analysis import KEYS, best_overall, report_rows

# ---------------------------------------------------------------------------
# FIXED VALUES — Markdown report texts (headings, labels, closing lines).
# ---------------------------------------------------------------------------
MD_TITLE = "# Relatório do Benchmark - LLMs para Detecção de Fake News"
MD_SUMMARY = ["## Resumo Executivo", "",
              "Este relatório apresenta os resultados do benchmark comparativo de Large Language Models (LLMs) ",
              "locais para a tarefa de detecção de fake news em português brasileiro.", "",
              "## Resultados Gerais", "", "### Tabela de Métricas", ""]
MD_BY_MODEL = "## Análise por Modelo"
MD_BY_STRATEGY = "## Análise por Estratégia de Prompting"
MD_MEAN_F1 = "- **F1-Score Médio:** "
MD_BEST_STRATEGY = "- **Melhor Estratégia:** "
MD_BEST_MODEL = "- **Melhor Modelo:** "
MD_CONCLUSIONS = ["## Conclusões", "",
                  "Os resultados demonstram que [análise a ser completada após execução dos experimentos].", "",
                  "## Metodologia", ""]
MD_MODELS = "- **Modelos testados:** "
MD_STRATEGIES = "- **Estratégias de prompting:** "
MD_DATASETS = "- **Datasets:** "
MD_FOOTER = ["", "---", "*Relatório gerado automaticamente pelo benchmark de LLMs para Fake News.*"]
# ---------------------------------------------------------------------------

TABLE_COLS = ["model", "strategy", "dataset", "accuracy", "precision", "recall", "f1_score", "avg_inference_time",
              "vram_usage_gb", "invalid_rate", "error"]
FORMATTED = {"accuracy", "precision", "recall", "f1_score", "invalid_rate"}


def _cell(c: str) -> Column:
    if c in FORMATTED:
        return format_metric(c)
    # a bar or a line break in an error text would end the table's cell or row
    plain = F.regexp_replace(F.col(c).cast("string"), r"\s*[\r\n]+\s*", " ")
    return F.coalesce(F.replace(plain, F.lit("|"), F.lit("\\|")), F.lit(""))


def _const(spark: SparkSession, section: int, lines: list[str]) -> DataFrame:
    return spark.createDataFrame([(section, i, s) for i, s in enumerate(lines)], "section int, ord long, line string")


def markdown_lines(report: DataFrame) -> DataFrame:
    """``section, ord, line`` of the Markdown report."""
    spark = report.sparkSession
    parts = [_const(spark, 0, [MD_TITLE, ""] + MD_SUMMARY)]
    header = "| " + " | ".join(TABLE_COLS) + " |"
    sep = "|" + "|".join("---" for _ in TABLE_COLS) + "|"
    parts.append(_const(spark, 1, [header, sep]))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[_cell(c) for c in TABLE_COLS]), F.lit(" |"))
    w = Window.orderBy(*KEYS)
    parts.append(report.select(F.lit(2).alias("section"), F.row_number().over(w).cast("long").alias("ord"),
                               row.alias("line")))
    parts.append(_const(spark, 3, ["", MD_BY_MODEL, ""]))
    parts.append(_group_lines(report, "model", "strategy", 4, MD_BEST_STRATEGY, title=False))
    parts.append(_const(spark, 5, ["", MD_BY_STRATEGY, ""]))
    parts.append(_group_lines(report, "strategy", "model", 6, MD_BEST_MODEL, title=True))
    parts.append(_const(spark, 7, [""] + MD_CONCLUSIONS))
    lists = report.agg(*[F.array_join(F.array_sort(F.collect_set(c)), ", ").alias(c) for c in KEYS])
    parts.append(lists.select(F.lit(8).alias("section"), F.lit(0).cast("long").alias("ord"),
                              F.concat(F.lit(MD_MODELS), "model").alias("line")))
    parts.append(lists.select(F.lit(8), F.lit(1).cast("long"), F.concat(F.lit(MD_STRATEGIES), "strategy")))
    parts.append(lists.select(F.lit(8), F.lit(2).cast("long"), F.concat(F.lit(MD_DATASETS), "dataset")))
    parts.append(_const(spark, 9, MD_FOOTER))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _group_lines(report: DataFrame, key: str, other: str, section: int, best_label: str, title: bool) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last("f1_score"), *[k for k in KEYS if k != key])
    ranked = report.withColumn("_rn", F.row_number().over(w))
    g = ranked.groupBy(key).agg(
        F.avg("f1_score").alias("_mean"),
        F.max(F.when((F.col("_rn") == 1) & F.col("f1_score").isNotNull(), F.col(other))).alias("_best"))
    name = display_title(key) if title else F.col(key)
    gw = Window.orderBy(key)
    g = g.withColumn("_g", F.row_number().over(gw))
    lines = F.array(F.concat(F.lit("### "), name), F.lit(""),
                    F.concat(F.lit(MD_MEAN_F1), format_metric("_mean")),
                    F.concat(F.lit(best_label), F.coalesce(F.col("_best"), F.lit("N/A"))), F.lit(""))
    ex = g.select("_g", F.posexplode(lines).alias("_i", "line"))
    return ex.select(F.lit(section).alias("section"), (F.col("_g") * 10 + F.col("_i")).cast("long").alias("ord"),
                     "line")


def write_markdown(report: DataFrame, path: str) -> None:
    lines = markdown_lines(report).orderBy("section", "ord").select("line")
    lines.coalesce(1).write.mode("overwrite").text(path)


def generate_report(results: DataFrame, output_dir: str) -> DataFrame:
    """Report rows from result documents; writes the CSV table and the
    Markdown document under ``output_dir``; returns the report."""
    report = report_rows(results)
    write_csv(report, f"{output_dir.rstrip('/')}/benchmark_report_csv", single_file=True)
    write_markdown(report, f"{output_dir.rstrip('/')}/benchmark_report_md")
    return report


def best_result(report: DataFrame) -> DataFrame:
    return best_overall(report)
