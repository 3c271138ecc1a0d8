"""Names for columns an operator adds for a while beside those a caller's table has."""

from __future__ import annotations

from collections.abc import Iterable


def spare_name(taken: Iterable[str], stem: str) -> str:
    """``stem``, or with the first number that no column of ``taken`` has, letter case aside."""
    known = {c.lower() for c in taken}
    name, n = stem, 0
    while name.lower() in known:
        n += 1
        name = f"{stem}_{n}"
    return name
