"""Aggregates with respect to an ancestor.

``agg(item, wrt=ancestor)`` has a value for every object of ``wrt``; without
``wrt`` (or with the dataset) it is one value for all.  Groups are the identities
of all objects down to ``wrt``.  Below ``wrt`` only what exists takes part; empty
groups get the fill of ``EMPTY``.  Called with plain iterables the functions do
what their Python namesakes do.
"""

from __future__ import annotations

import builtins
import statistics
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.errors import DisjointPathError
from orrery.operators.query import Aggregate, AttributeQuery, Expression, Node, ObjectQuery, Query, _tag, as_expression

#: Values of empty groups; null for those that aren't here.
EMPTY = {"sum": 0, "count": 0, "exists": False, "any": False, "all": True, "std": 0.0}


def _wrt(wrt) -> Node | None:
    return wrt.node if isinstance(wrt, ObjectQuery) else None


def aggregate(item, wrt, name: str, make: Callable[[Column], Column], fill=None, nulls: bool = False) -> AttributeQuery:
    """An aggregate expression at the level of ``wrt``."""
    top = _wrt(wrt)
    if wrt is not None and isinstance(wrt, AttributeQuery):
        raise DisjointPathError("wrt is an object that was passed on the way, not an attribute")
    e = as_expression(item) if not isinstance(item, ObjectQuery) else Expression(item.node, F.col(item.node.id), f"id@{item.node.key}")
    if e.node is None and not e.needs:
        raise DisjointPathError("there is nothing to aggregate")
    if top is not None and (e.node is None or not e.node.under(top)):
        raise DisjointPathError("the aggregated item isn't below wrt")
    if e.node is not None and isinstance(e.type, T.FractionalType):
        e = Expression(e.node, _finite(e.column), e.key, e.needs, e.product, e.name)
    key = f"{name}({e.key}@{e.node.key if e.node else ''},{top.key if top else ''})"
    column = "a" + _tag(key)
    held = Aggregate(column, top, e, make, fill, nulls)
    return AttributeQuery(item.data, Expression(top, F.col(column), key, (held,), name=name))


def _finite(c: Column) -> Column:
    """NaN and infinities are missing values."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def _plain(item) -> bool:
    return not isinstance(item, Query)


def _number(c: Column, e: Expression) -> Column:
    return c.cast("bigint") if isinstance(e.type, T.BooleanType) else c


def _fill(name: str, e: Expression):
    value = EMPTY.get(name)
    if name == "sum" and isinstance(e.type, T.FractionalType):
        return 0.0
    return F.lit(0).cast("bigint") if name in ("sum", "count") else value


def sum(item, wrt=None):
    if _plain(item):
        return builtins.sum(item)
    e = as_expression(item)
    return aggregate(item, wrt, "sum", lambda c: F.coalesce(F.sum(_number(c, e)), F.lit(0)), _fill("sum", e))


def max(item, *more, wrt=None):
    return builtins.max(item, *more) if _plain(item) else aggregate(item, more[0] if more else wrt, "max", F.max)


def min(item, *more, wrt=None):
    return builtins.min(item, *more) if _plain(item) else aggregate(item, more[0] if more else wrt, "min", F.min)


def mean(item, wrt=None):
    return statistics.fmean(item) if _plain(item) else aggregate(item, wrt, "mean", F.avg)


def std(item, wrt=None):
    """Sample standard deviation; 0 for fewer than two values."""
    if _plain(item):
        values = list(item)
        return statistics.stdev(values) if len(values) > 1 else 0.0
    return aggregate(item, wrt, "std", lambda c: F.when(F.count(c) < 2, 0.0).otherwise(F.stddev_samp(c)), EMPTY["std"])


def count(item, wrt=None, distinct: bool = False):
    if _plain(item):
        return len(set(item)) if distinct else len(list(item))
    if not isinstance(item, ObjectQuery | AttributeQuery):
        item = item.index  # a table has as many rows as its index
    # an object that is there counts, whatever its identity
    number = F.count_distinct if distinct else (lambda c: F.count("*")) if isinstance(item, ObjectQuery) else F.count
    return aggregate(item, wrt, "count_distinct" if distinct else "count", number, F.lit(0).cast("bigint"))


def exists(item, wrt=None):
    if _plain(item):
        return builtins.any(True for _ in item)
    out = aggregate(item, wrt, "exists", (lambda c: F.count("*") > 0) if isinstance(item, ObjectQuery) else (lambda c: F.count(c) > 0), EMPTY["exists"])
    if isinstance(item, ObjectQuery) and _wrt(wrt) is not None:
        out.semi = (item.node, _wrt(wrt), "left_semi")
    return out


def any(item, wrt=None):
    if _plain(item):
        return builtins.any(item)
    return aggregate(item, wrt, "any", lambda c: F.coalesce(F.bool_or(c.cast("boolean")), F.lit(False)), EMPTY["any"])


def all(item, wrt=None):
    if _plain(item):
        return builtins.all(item)
    return aggregate(item, wrt, "all", lambda c: F.coalesce(F.bool_and(c.cast("boolean")), F.lit(True)), EMPTY["all"])


def array(item, wrt=None, distinct: bool = False, nulls: bool = False):
    """The values as a sorted list; with ``nulls`` also those of masked and missing objects."""
    if _plain(item):
        return sorted(set(item)) if distinct else list(item)
    e = as_expression(item)
    empty = F.array().cast(T.ArrayType(e.type))
    if nulls:
        return aggregate(item, wrt, "array_nulls", lambda c: F.array_sort(F.transform(F.collect_list(F.struct(c.alias("x"))), lambda s: s["x"])), empty, nulls=True)
    return aggregate(item, wrt, f"array{distinct}", lambda c: F.array_sort(F.collect_set(c) if distinct else F.collect_list(c)), empty)
