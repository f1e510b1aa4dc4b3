"""Scoring rows with pluggable models.

Two kinds of model:

* :class:`ExprModel` — the answer is a SQL expression over the prompt.  It
  stays in the JVM (whole-stage codegen); used for deterministic rule
  responders and for checks against a SQL oracle.
* :class:`PythonModel` — a factory returning ``generate(prompts: Series) ->
  Series``.  Rows are scored with ``mapInPandas``: the factory is called once
  per task, prompts arrive in Arrow batches.  A batch that fails, or returns
  another number of answers, is retried row by row, so that a bad row gets an
  ``error`` instead of failing the task; an optional fallback model is tried
  for failed rows.  A factory that fails gives its model's rows that error.
  ``concurrency`` keeps that many calls in flight in a task (back ends that wait
  for a server), ``retries`` repeats a failed call after a growing pause.

Both produce ``response string, inference_time double, error string``.

Generation options are the benchmark's defaults, overridden by the model's, over-
ridden by the row's (``options_col``, a struct whose null fields override nothing).
A back end gets those of each call: ``generate(prompts, options)``, or, if its
``generate`` takes prompts only, an instance made by the factory for each distinct
set of options.
"""

from __future__ import annotations

import json
import sys
import time
from concurrent.futures import ThreadPoolExecutor
from threading import Lock
from dataclasses import dataclass, field
from typing import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import free_name


@dataclass
class ExprModel:
    name: str
    sql: str  # expression over the column ``prompt``
    backend_name: str | None = None
    options: dict = field(default_factory=dict)


@dataclass
class PythonModel:
    name: str
    factory: Callable[[], Callable[[pd.Series], pd.Series]]
    backend_name: str | None = None
    fallback_factory: Callable[[], Callable[[pd.Series], pd.Series]] | None = None
    options: dict = field(default_factory=dict)
    per_row: bool = False  # ask for one answer at a time, each with its own time
    concurrency: int = 1   # calls of one row each in flight in a task; over 1 implies per_row
    retries: int = 0       # further tries of a failed call, before the fallback
    backoff: float = 0.5   # seconds before the first further try, doubled for each one after it


# model factories defined in this package travel to the Python workers by
# value, so executors need no copy of the package to score rows
cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])

def unmapped_error(model) -> "F.Column":
    return F.concat(F.lit("model '"), model, F.lit("' is not in the back-end registry"))

SCORED_FIELDS = [
    T.StructField("response", T.StringType()),
    T.StructField("inference_time", T.DoubleType()),
    T.StructField("error", T.StringType()),
]


def deterministic_latency(prompt: str = "prompt"):
    """Stand-in latency for reproducible runs: prompt length / 10,000 s."""
    return F.char_length(F.col(prompt)) / F.lit(10000.0)


def generation_options(model) -> dict:
    """Benchmark-wide generation defaults merged with the model's own
    overrides (the model wins), and the name the back end knows it by."""
    from ..config import EXPERIMENT_CONFIG
    named = {"backend_name": model.backend_name} if model.backend_name else {}
    return {**EXPERIMENT_CONFIG["generation_params"], **(model.options or {}), **named}


def _make(factory, options: dict):
    """Call a model factory with the generation options when it takes them."""
    import inspect
    try:
        takes = len(inspect.signature(factory).parameters) > 0
    except (TypeError, ValueError):
        takes = False
    return factory(options) if takes else factory()


NO_PROMPT_ERROR = "no prompt for this row"


def _error(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


#: The longest pause before a further try, in seconds.
MOST_BACKOFF = 30.0


class _Scorer:
    """One Python model in one task.  The back end is opened on the first row
    that needs it; a back end that cannot be opened fails its own rows only."""

    def __init__(self, model: PythonModel):
        self.model, self.options = model, generation_options(model)
        self._made: dict = {}
        self._lock = Lock()

    def _open(self, which: str, options: dict):
        """A function of (prompts, options), made once for the options it needs."""
        factory = self.model.factory if which == "primary" else self.model.fallback_factory
        with self._lock:
            made = self._made.get(which)
            if made is None:
                made = self._made[which] = self._make(factory, options)
            if made[0] is not None and not made[2]:  # takes prompts only: an instance for each set of options
                key = which, json.dumps(options, sort_keys=True, default=str)
                if key not in self._made:
                    self._made[key] = made if options == made[3] else self._make(factory, options)
                made = self._made[key]
        generate, error, with_options, _ = made
        if error is not None:
            raise error
        return generate if with_options else lambda prompts, _: generate(prompts)

    @staticmethod
    def _make(factory, options: dict) -> tuple:
        try:
            generate = _make(factory, options)
            return generate, None, _takes(generate, 2), options
        except Exception as e:
            return None, e, False, options

    def _answers(self, which: str, prompts: pd.Series, options: dict) -> list:
        answers = list(self._open(which, options)(prompts, options))
        if len(answers) != len(prompts):
            raise ValueError(f"{len(answers)} answers for {len(prompts)} prompts")
        return answers

    def _one(self, prompt, options: dict) -> tuple:
        """One row: the answer of the first try that gives one, and that try's time."""
        answer, error, pause, taken = None, None, self.model.backoff, 0.0
        for attempt in range(self.model.retries + 1):
            if attempt:
                time.sleep(min(pause, MOST_BACKOFF))
                pause *= 2
            start = time.perf_counter()
            try:
                answer, error = self._answers("primary", pd.Series([prompt]), options)[0], None
            except Exception as e:
                error = _error(e)
            taken = time.perf_counter() - start
            if error is None:
                return answer, taken, None
        if self.model.fallback_factory is not None:
            start = time.perf_counter()
            try:
                answer, error = self._answers("fallback", pd.Series([prompt]), options)[0], None
            except Exception as e:
                error = _error(e)
            taken += time.perf_counter() - start
        return answer, taken, error

    def score(self, prompts: pd.Series, options: dict | None = None) -> list[tuple]:
        """(response, seconds, error) of each prompt, in their order."""
        options = self.options | (options or {})
        if not self.model.per_row and self.model.concurrency <= 1:
            start = time.perf_counter()
            try:
                answers = self._answers("primary", prompts, options)
                share = (time.perf_counter() - start) / max(len(answers), 1)
                return [(a, share, None) for a in answers]
            except Exception:
                pass  # each row by itself below, so that only bad rows fail
        if self.model.concurrency <= 1:
            return [self._one(p, options) for p in prompts]
        # at most ``concurrency`` calls at a time; map() gives the answers back in order
        with ThreadPoolExecutor(max_workers=self.model.concurrency) as window:
            return list(window.map(lambda p: self._one(p, options), prompts))


def _takes(function, n: int) -> bool:
    """Whether a function takes ``n`` positional arguments."""
    import inspect
    try:
        kinds = [p.kind for p in inspect.signature(function).parameters.values()]
    except (TypeError, ValueError):
        return False
    return kinds.count(inspect.Parameter.VAR_POSITIONAL) > 0 or \
        sum(k in (inspect.Parameter.POSITIONAL_ONLY, inspect.Parameter.POSITIONAL_OR_KEYWORD) for k in kinds) >= n


def _python_scorer(models: list[PythonModel], prompt_col: str, model_col: str, options_json: str | None = None):
    def run(batches):
        scorers = {m.name: _Scorer(m) for m in models}
        for pdf in batches:
            out = pdf.copy()
            rows = [(None, None, NO_PROMPT_ERROR)] * len(out)
            keys = [model_col] + ([options_json] if options_json else [])
            for key, at in out.groupby(keys, sort=False).indices.items():
                asked = [i for i in at if out[prompt_col].iloc[i] is not None]
                if asked:
                    key = key if isinstance(key, tuple) else (key,)
                    prompts = out[prompt_col].iloc[asked].reset_index(drop=True)
                    options = json.loads(key[1]) if options_json else None
                    for i, row in zip(asked, scorers[key[0]].score(prompts, options)):
                        rows[i] = row
            for i, field_ in enumerate(SCORED_FIELDS):
                kind = "float64" if field_.name == "inference_time" else object
                out[field_.name] = pd.Series([r[i] for r in rows], index=out.index, dtype=kind)
            yield out
    return run


#: Options that a row may override, and what it was asked with.
OPTIONS_TYPE = T.StructType([
    T.StructField("max_new_tokens", T.IntegerType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("top_p", T.DoubleType()),
    T.StructField("do_sample", T.BooleanType()),
    T.StructField("repetition_penalty", T.DoubleType()),
])


def effective_options(df: DataFrame, models: list, options_col: str, model_col: str = "model") -> DataFrame:
    """``options_col`` completed: a field that the row leaves out (null, or not in
    its struct) has the model's value, and else the benchmark's."""
    from ..config import EXPERIMENT_CONFIG
    given = {f.name for f in df.schema[options_col].dataType.fields}
    fields = []
    for f in OPTIONS_TYPE.fields:
        value = F.lit(EXPERIMENT_CONFIG["generation_params"].get(f.name))
        for m in models:
            if f.name in (m.options or {}):
                value = F.when(F.col(model_col) == m.name, F.lit(m.options[f.name])).otherwise(value)
        own = F.col(options_col)[f.name].cast(f.dataType) if f.name in given else F.lit(None)
        fields.append(F.coalesce(own, value.cast(f.dataType)).alias(f.name))
    return df.withColumn(options_col, F.struct(*fields))


def score(df: DataFrame, models: list, prompt_col: str = "prompt", model_col: str = "model",
          timing: str = "wall", partitions: int | None = None, options_col: str | None = None) -> DataFrame:
    """Add ``response``, ``inference_time`` and ``error`` to rows that carry a
    model name.  Rows whose model is not registered, or whose prompt is NULL,
    get an error.

    All Python models run in one ``mapInPandas``, so the input is read once for
    them.  ``inference_time`` is measured for Python models: a row's own time
    where rows are scored one by one (``per_row``, or after a failed batch), its
    share of the batch's time otherwise.  Expression models have no time of
    their own (NULL).  ``timing="prompt_length"`` replaces both with
    :func:`deterministic_latency` (reproducible runs).

    ``options_col``: a struct of generation options for each row; it comes back as
    what the row was asked with (:func:`effective_options`).  An expression model
    may use it by name; a Python model is asked once for each set of options in a
    batch.

    ``partitions`` sets the number of Python tasks (default: the cluster's
    default parallelism, so that model calls are spread over all executors
    rather than over however many partitions the prompts had)."""
    expr_models = [m for m in models if isinstance(m, ExprModel)]
    py_models = [m for m in models if isinstance(m, PythonModel)]
    known = [m.name for m in models]
    m = F.col(model_col)
    if options_col:
        df = effective_options(df, models, options_col, model_col)

    # expression models and unregistered names: one JVM-side projection
    resp = None
    for em in expr_models:
        e = F.expr(em.sql)
        resp = F.when(m == em.name, e) if resp is None else resp.when(m == em.name, e)
    python_names = [pm.name for pm in py_models]
    is_python = F.coalesce(m.isin(*python_names), F.lit(False)) if py_models else F.lit(False)
    rest = df.where(~is_python) if py_models else df
    resp = resp if resp is not None else F.lit(None)
    unknown = ~F.coalesce(m.isin(*known), F.lit(False)) if known else F.lit(True)
    error = F.when(unknown, unmapped_error(F.coalesce(m, F.lit("")))).when(F.col(prompt_col).isNull(), NO_PROMPT_ERROR)
    out = rest.select("*", F.when(error.isNull(), resp).cast("string").alias("response"),
                      F.lit(None).cast("double").alias("inference_time"), error.cast("string").alias("error"))
    if py_models:
        n_tasks = partitions or df.sparkSession.sparkContext.defaultParallelism
        asked, text = df.where(is_python), None
        if options_col:  # as text through Python, where rows are grouped by it
            text = free_name([*df.columns, *(f.name for f in SCORED_FIELDS)], "options_json")
            asked = asked.withColumn(text, F.to_json(options_col)).drop(options_col)
        asked = asked.repartition(n_tasks)
        schema = T.StructType(asked.schema.fields + SCORED_FIELDS)
        answered = asked.mapInPandas(_python_scorer(py_models, prompt_col, model_col, text), schema)
        if options_col:
            answered = answered.withColumn(options_col, F.from_json(text, OPTIONS_TYPE)).drop(text)
        out = out.unionByName(answered)
    if timing == "prompt_length":
        out = out.withColumn("inference_time",
                             F.when(F.col("response").isNotNull(), deterministic_latency(prompt_col)))
    return out


def model_registry_frame(spark, models: list, mapping: dict | None = None):
    """Small frame ``model, backend_name, kind`` (J5 lookup side)."""
    rows = []
    for mdl in models:
        backend = mdl.backend_name or (mapping or {}).get(mdl.name)
        rows.append((mdl.name, backend, "expr" if isinstance(mdl, ExprModel) else "python"))
    return spark.createDataFrame(rows, "model string, backend_name string, kind string")
