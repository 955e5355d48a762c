"""Column names that can't clash with those of a caller's table."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """``wanted`` names, each lengthened until no column of ``taken`` (case
    ignored, as Spark resolves names) has it."""
    used = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out
