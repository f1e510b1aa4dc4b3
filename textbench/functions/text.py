"""Scalar text helpers as Column expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import PARAM_BIN_EDGES, PARAM_BIN_LABELS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text_length(text) -> Column:
    """Length in characters (code points), as ``len(str)`` counts them."""
    return F.char_length(_c(text)).cast("long")


def truncate_text(text, max_length: int = 2000) -> Column:
    """Cut to ``max_length`` characters, back off to the last blank when that
    blank sits strictly beyond 80 % of the limit, and append ``...``.

    Texts that already fit are returned unchanged.
    """
    t = _c(text)
    head = F.substring(t, 1, max_length)
    # 1-based position of the last blank counted from the end of ``head``;
    # 0 when there is none.  ``head`` has exactly max_length characters here.
    from_end = F.instr(F.reverse(head), " ")
    last_blank = F.when(from_end == 0, F.lit(-1)).otherwise(F.lit(max_length) - from_end)
    cut = F.when(last_blank > F.lit(max_length * 0.8), F.substring(head, 1, last_blank)).otherwise(head)
    return F.when(F.char_length(t) <= max_length, t).otherwise(F.concat(cut, F.lit("...")))


def strip_ws(s) -> Column:
    """``str.strip()`` for the usual blanks: space, tab, CR, LF."""
    return F.btrim(_c(s), F.lit(" \t\n\r"))


def model_parameters(model) -> Column:
    """Billions of parameters read from a model name (``1.5B``, ``4b``); NULL
    when the name carries none."""
    raw = F.regexp_extract(_c(model), r"(\d+\.?\d*)[Bb]", 1)
    return F.when(raw == "", F.lit(None).cast("double")).otherwise(raw.cast("double"))


def short_model_name(model) -> Column:
    """Last path element of a hub-style name."""
    return F.element_at(F.split(_c(model), "/"), -1)


def display_title(s) -> Column:
    """``snake_case`` -> ``Snake Case``: each run of letters begins with a capital one,
    the others are small, whatever stands between the runs (``gpt-4o`` -> ``Gpt-4O``)."""
    runs = F.split(F.regexp_replace(_c(s), "_", " "), r"(?<=\p{L})(?=\P{L})|(?<=\P{L})(?=\p{L})", -1)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), "")


def experiment_key(model, strategy, dataset) -> Column:
    """Result document key: model with ``/`` replaced, then strategy, dataset."""
    return F.concat_ws("_", F.regexp_replace(_c(model), "/", "_"), _c(strategy), _c(dataset))


def model_strategy_key(model, strategy) -> Column:
    return F.concat_ws("_", _c(model), _c(strategy))


def parameter_bin(params) -> Column:
    """Right-closed bins (0,2], (2,5], (5,10], (10,inf); <=0 or NULL -> NULL."""
    p = _c(params)
    expr = None
    for lo, hi, label in zip(PARAM_BIN_EDGES[:-1], PARAM_BIN_EDGES[1:], PARAM_BIN_LABELS):
        cond = (p > lo) & (p <= hi) if hi != float("inf") else (p > lo)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def parameter_bin_order(params) -> Column:
    """Sort key of :func:`parameter_bin` (bins are ordered categories)."""
    p = _c(params)
    expr = None
    for i, (lo, hi) in enumerate(zip(PARAM_BIN_EDGES[:-1], PARAM_BIN_EDGES[1:])):
        cond = (p > lo) & (p <= hi) if hi != float("inf") else (p > lo)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def normalize_backend_name(name) -> Column:
    """Back-end model names compared loosely: trim, hub URL -> ``hf.co/``;
    for ``hf.co/`` names drop the tag after the first ``:``; lower-case."""
    s = strip_ws(name)
    s = F.regexp_replace(s, r"https?://huggingface\.co/", "hf.co/")
    return F.lower(F.when(s.startswith("hf.co/"), F.split(s, ":").getItem(0)).otherwise(s))


def coerce_text(text) -> Column:
    return F.coalesce(_c(text), F.lit(""))


def argmax_index(arr) -> Column:
    """0-based index of the first maximum of an array (class logits)."""
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def iso_timestamp() -> Column:
    """Local wall clock as ISO-8601 text with microseconds."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def format_metric(x, digits: int = 4) -> Column:
    """Fixed-point text, NULL -> ``N/A`` (display only)."""
    return F.coalesce(F.format_string(f"%.{digits}f", _c(x)), F.lit("N/A"))
