"""Names for columns of an operator's own, apart from those of its input."""

from __future__ import annotations


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """Each of ``wanted`` with as many underscores before it as keep it apart from ``columns``, upper or lower case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
