"""Scalar functions over attribute queries; plain numbers go to Python's own."""

from __future__ import annotations

import builtins
import functools
import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.operators.query import AttributeQuery, ObjectQuery, Query, as_expression, combine


def _scalar(key: str, make: Callable[[Column], Column], plain: Callable) -> Callable:
    def call(x, *args):
        return combine([x], lambda c: make(c, *args), f"{key}{args}") if isinstance(x, Query) else plain(x, *args)

    call.__name__ = key
    return call


def _or_null(f: Callable, test: Callable) -> Callable:
    return lambda x: f(x) if test(x) else None


abs = _scalar("abs", F.abs, builtins.abs)
ceil = _scalar("ceil", F.ceil, math.ceil)
floor = _scalar("floor", F.floor, math.floor)
round = _scalar("round", lambda c, n=0: F.round(c, n), builtins.round)
sign = _scalar("sign", F.signum, lambda x: (x > 0) - (x < 0))
exp = _scalar("exp", F.exp, math.exp)
log = _scalar("log", F.ln, _or_null(math.log, lambda x: x > 0))
log10 = _scalar("log10", F.log10, _or_null(math.log10, lambda x: x > 0))
#: Null for negative numbers.
sqrt = _scalar("sqrt", lambda c: F.when(c >= 0, F.sqrt(c)), _or_null(math.sqrt, lambda x: x >= 0))
isnull = ismissing = _scalar("isnull", F.isnull, lambda x: x is None)
isnan = _scalar("isnan", lambda c: F.isnan(c.cast("double")), math.isnan)
to_int = _scalar("to_int", lambda c: c.try_cast("bigint"), int)
to_float = _scalar("to_float", lambda c: c.try_cast("double"), float)
string = _scalar("string", lambda c: c.cast("string"), str)
lower = _scalar("lower", F.lower, str.lower)
upper = _scalar("upper", F.upper, str.upper)


def rand(query: AttributeQuery, seed: int = 0) -> AttributeQuery:
    """A random number for each row, the same again for the same seed and plan."""
    return combine([query], lambda c: F.rand(seed), f"rand{seed}")


def object_id(obj: ObjectQuery) -> AttributeQuery:
    """The identity of an object."""
    return obj.id


def replace(item: AttributeQuery, old: str, new: str) -> AttributeQuery:
    """Text with every ``old`` replaced."""
    return combine([item], lambda c: F.replace(c, F.lit(old), F.lit(new)), f"replace({old!r},{new!r})") if isinstance(item, Query) else item.replace(old, new)


def append(item: AttributeQuery, *more) -> AttributeQuery:
    """Text with others put behind it; a missing one counts as empty."""
    if not isinstance(item, Query):
        return "".join(str(x) for x in (item, *more) if x is not None)
    return combine([item, *more], lambda *cs: F.concat_ws("", *[c.cast("string") for c in cs]), "append")


def element(item: AttributeQuery, key) -> AttributeQuery:
    """The value of a map's key, or of a list's place (from 0); null where there is none."""
    place = isinstance(key, int) and not isinstance(key, bool)
    if not isinstance(item, Query):
        return (item[key] if 0 <= key < len(item) else None) if place and not isinstance(item, dict) else item.get(key)
    if place and isinstance(as_expression(item).type, T.ArrayType):
        return combine([item], lambda c: F.get(c, F.lit(key)), f"element{key}")
    return combine([item], lambda c: F.try_element_at(c, F.lit(key)), f"element({key!r})")


def filtered(item: AttributeQuery, keep: Callable[[Column], Column] | None = None, make: Callable[[Column], Column] | None = None) -> AttributeQuery:
    """A list with the values that ``keep`` holds for, each as ``make`` has it."""

    def run(c: Column) -> Column:
        c = c if keep is None else F.filter(c, keep)
        return c if make is None else F.transform(c, make)

    return combine([item], run, f"filtered{next(_NTH)}")


_NTH = itertools.count()


def switch(item: AttributeQuery, states, default=None) -> AttributeQuery:
    """The value of the state that ``item`` equals, else the default; values are queries or constants of one type.

    With one value instead of states ``item`` is a condition: the value where it holds, else the default.
    """
    if not isinstance(states, dict):
        if not isinstance(as_expression(item).type, T.BooleanType):
            raise TypeError("without states a switch needs a condition")
        states = {True: states}
    values = [*states.values(), *([] if default is None else [default])]
    kinds = {_kind(v) for v in values}
    if len(kinds) > 1:
        raise TypeError(f"the results of a switch must have one type, not {', '.join(sorted(kinds))}")
    keys = list(states)

    def make(x: Column, *results: Column) -> Column:
        out = functools.reduce(lambda w, kr: w.when(x == kr[0], kr[1]), zip(keys[1:], results[1:], strict=False), F.when(x == keys[0], results[0]))
        return out if default is None else out.otherwise(results[-1])

    return combine([item, *values], make, f"switch{keys!r}")


def _kind(v) -> str:
    if isinstance(v, Query):
        t = as_expression(v).type
        return "number" if isinstance(t, T.NumericType) else t.simpleString()
    if isinstance(v, bool):
        return "boolean"
    return "number" if isinstance(v, int | float) else "string"


def reduce(function: Callable, queries: list, initial=None):
    """Fold a list of expressions with a function of two."""
    return functools.reduce(function, queries) if initial is None else functools.reduce(function, queries, initial)
