"""Fingerprints of experiments: what they were run on, and with.

A scored row or a fitted model may be used again only if it is the answer to the
same question.  The question is the rows (a digest that does not depend on their
order or partitions: number, sum and exclusive or of two row hashes, taken in one
partial aggregate) and the settings (a digest of plain values and of the code of
functions).  Equal fingerprints mean equal questions; a digest that differs without
need costs a rerun and nothing else.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import types

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_digest(columns: list[Column | str]) -> Column:
    """Aggregate: a text that is the same for the same multiset of rows."""
    cols = [F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(None)) for c in columns]
    # a null and an empty value differ, as does a value in the next column
    shown = [x for c in cols for x in (c.isNull(), c)]
    parts = [F.count(F.lit(1)).cast("string")]
    for salt in (1, 2):
        h = F.xxhash64(F.lit(salt), *shown)
        parts += [F.sum(h.cast("decimal(20,0)")).cast("string"), F.bit_xor(h).cast("string")]
    return F.concat_ws(":", *parts)


def _code(function, seen: set) -> list:
    """What a function computes: byte code, names, constants, defaults, what it
    closes over and the functions of its own module that it names."""
    if id(function) in seen:
        return ["again"]
    seen.add(id(function))
    code = getattr(function, "__code__", None)
    if code is None:
        return [type(function).__module__, type(function).__qualname__, _plain(vars(function), seen)
                if hasattr(function, "__dict__") else repr(function)]

    def body(c) -> list:
        return [c.co_code.hex(), list(c.co_names), list(c.co_varnames),
                [body(k) if isinstance(k, types.CodeType) else _plain(k, seen) for k in c.co_consts]]

    def names(c):
        return set(c.co_names).union(*(names(k) for k in c.co_consts if isinstance(k, types.CodeType)))
    cells = []
    for cell in function.__closure__ or ():
        try:
            cells.append(_plain(cell.cell_contents, seen))
        except ValueError:
            cells.append("empty")
    used = {n: function.__globals__[n] for n in sorted(names(code)) if n in function.__globals__}
    own = {n: _plain(v, seen) for n, v in used.items()
           if not isinstance(v, types.ModuleType) and getattr(v, "__module__", function.__module__) == function.__module__}
    return [body(code), _plain(function.__defaults__, seen), _plain(function.__kwdefaults__, seen), cells, own]


def _plain(value, seen: set):
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    if isinstance(value, bytes):
        return value.hex()
    if isinstance(value, dict):
        return sorted(([str(k), _plain(v, seen)] for k, v in value.items()), key=lambda x: x[0])
    if isinstance(value, (list, tuple)):
        return [_plain(v, seen) for v in value]
    if isinstance(value, (set, frozenset)):
        return sorted(json.dumps(_plain(v, seen), default=str) for v in value)
    if isinstance(value, type):
        return [value.__module__, value.__qualname__]
    if isinstance(value, types.MethodType):
        return [_code(value.__func__, seen), _plain(value.__self__, seen)]
    if callable(value) or hasattr(value, "__code__"):
        return _code(value, seen)
    if dataclasses.is_dataclass(value):
        return [type(value).__qualname__, _plain({f.name: getattr(value, f.name) for f in dataclasses.fields(value)}, seen)]
    if id(value) in seen:
        return "again"
    seen.add(id(value))
    state = getattr(value, "__dict__", None)
    return [type(value).__module__, type(value).__qualname__, _plain(state, seen) if state else ""]


def settings_digest(*settings) -> str:
    """A text that is the same for the same settings: numbers, texts, lists, dicts,
    dataclasses and functions (by their code, not by their name or place)."""
    return hashlib.sha256(json.dumps([_plain(s, set()) for s in settings], default=str).encode()).hexdigest()[:32]


def digests(df: DataFrame, columns: list, by: list[str]) -> dict[tuple, str]:
    """{group: digest} of a frame with few groups (experiments, parts of a split)."""
    rows = df.groupBy(*by).agg(rows_digest(columns).alias("digest")).collect()
    return {tuple(r[b] for b in by): r["digest"] for r in rows}
