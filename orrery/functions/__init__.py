"""Functions of the query language: aggregates, scalars, switch and reduce.

Each takes aligned queries as well, and then gives aligned ones: the function goes
to every member, with the members of the same name of its other arguments.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from orrery.functions import aggregates as _aggregates
from orrery.functions import scalars as _scalars
from orrery.operators.combine import Aligned

_NAMES = {
    _aggregates: ("all", "any", "array", "count", "exists", "max", "mean", "min", "std", "sum"),
    _scalars: (
        "abs", "append", "ceil", "element", "exp", "filtered", "floor", "isnan", "ismissing", "isnull", "log", "log10", "lower", "object_id", "rand", "reduce", "replace", "round", "sign", "sqrt",
        "string", "switch", "to_float", "to_int", "upper",
    ),
}


def _for_aligned(f: Callable) -> Callable:
    @functools.wraps(f)
    def call(*args, **how):
        found = [x for x in (*args, *how.values()) if isinstance(x, Aligned)]
        if not found:
            return f(*args, **how)
        of = lambda x, k: x.members[k] if isinstance(x, Aligned) else x
        return Aligned({k: f(*[of(x, k) for x in args], **{n: of(x, k) for n, x in how.items()}) for k in found[0].members})

    return call


for _module, _names in _NAMES.items():
    for _name in _names:
        globals()[_name] = _for_aligned(getattr(_module, _name))

__all__ = [n for names in _NAMES.values() for n in names]  # noqa: PLE0604
