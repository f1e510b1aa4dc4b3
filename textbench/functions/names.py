"""Names for helper columns that no column of the caller has."""

from __future__ import annotations


def free_name(taken, name: str) -> str:
    """``name``, with as many underscores before it as it takes to differ from
    every name in ``taken``, whatever the case."""
    used = {str(t).lower() for t in taken}
    while name.lower() in used:
        name = "_" + name
    return name
