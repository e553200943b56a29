"""Names: snake case, plurals, and suggestions for misspelt ones."""

from __future__ import annotations

import re
from collections.abc import Iterable

#: Words that have no plural of their own.
SAME = ("series", "species", "data")


def snake(name: str) -> str:
    """CamelCase to snake_case."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def plural(name: str) -> str:
    """The plural of a snake_case noun; dotted names change in the last part."""
    head, dot, last = name.rpartition(".")
    if last.endswith(SAME):
        out = last
    elif re.search(r"(s|x|z|ch|sh)$", last):
        out = last + "es"
    elif re.search(r"[^aeiou]y$", last):
        out = last[:-1] + "ies"
    else:
        out = last + "s"
    return head + dot + out


def similarity(a: str, b: str) -> float:
    """Jaro-Winkler similarity, 0 to 1."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, left, right = [False] * len(b), [], []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                left.append(x)
                break
    right = [y for j, y in enumerate(b) if used[j]]
    m = len(left)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def suggest(name: str, known: Iterable[str], n: int = 3) -> list[str]:
    """The ``n`` most similar known names, best first."""
    return sorted(set(known), key=lambda k: (-similarity(name.lower(), k.lower()), k))[:n]
