"""Combining queries: uploads, splits and alignment."""

from __future__ import annotations

import operator
import warnings
from collections.abc import Callable, Iterator
from itertools import count, zip_longest
from itertools import product as pairs

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.errors import DisjointPathError
from orrery.operators.query import SMALL, AttributeQuery, Expression, Node, ObjectQuery, Query, as_expression, combine
from orrery.operators.tables import Table

#: Columns of an upload with longer lists than this are left out.
WIDEST = 100


class Rows:
    """The uploaded rows that belong to the objects of a query: ``rows['column']``."""

    def __init__(self, objects: ObjectQuery, tag: str, columns: list[str]):
        self.objects, self.tag, self.columns = objects, tag, columns

    def __getitem__(self, name: str) -> AttributeQuery:
        if name not in self.columns:
            raise KeyError(name)
        node = self.objects.node
        return AttributeQuery(node.data, Expression(node, F.col(f"{self.tag}_{name}"), f"{self.tag}.{name}", name=name))

    __getattr__ = __getitem__


#: Each upload has columns of its own, in the order of the calls.
_UPLOADS = count(1)


def upload(data, table: pd.DataFrame | DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, bool]:
    """A local table (or only some of its columns) as a frame without its wide columns, and whether it is small enough to broadcast."""
    if columns is not None:
        table = table.select(*columns) if isinstance(table, DataFrame) else table[columns]
    if isinstance(table, DataFrame):
        return table, False
    wide = [c for c in table.columns if len(table) and table[c].map(lambda x: len(x) if isinstance(x, list | tuple) else 0).max() > WIDEST]
    if wide:
        warnings.warn(f"columns {wide} are too wide and aren't uploaded", stacklevel=3)
    return data.spark.createDataFrame(table.drop(columns=wide)), len(table) <= SMALL


def join(table, on: str | list[str], objects: ObjectQuery, attributes: AttributeQuery | list[AttributeQuery] | None = None, how: str = "inner", columns: list[str] | None = None) -> tuple[Rows, ObjectQuery]:
    """Join a local table to objects; gives the rows' handle and the joined objects.

    Of the table's columns only those of ``columns`` (all, if not given) and the keys leave this machine.

    ``how`` is ``inner`` (objects with a row), ``left_object`` (all objects) or
    ``left_table`` (all rows).  Keys that repeat multiply the objects.
    """
    keys = [on] if isinstance(on, str) else list(on)
    values = [objects._default()] if attributes is None else list(attributes) if isinstance(attributes, list | tuple) else [attributes]
    if len(keys) != len(values):
        raise ValueError("as many attributes as key columns are needed")
    frame, small = upload(objects.data, table, None if columns is None else list(dict.fromkeys([*keys, *columns])))
    node = objects.node
    tag = f"u{next(_UPLOADS)}"
    right = frame.select(*[F.col(f"`{c}`").alias(f"{tag}_{c}") for c in frame.columns])
    exprs = [as_expression(v) for v in values]
    kind = {"inner": "inner", "left_object": "left", "left_table": "right"}[how]

    def extend(df: DataFrame, outer: bool) -> DataFrame:
        for e in exprs:
            df = e.on(df, node)
        other = F.broadcast(right) if small and kind != "right" else right
        have = [*df.columns, *right.columns]
        held = df.withColumns({f"{tag}k{i}": e.column for i, e in enumerate(exprs)})
        test = [F.col(f"{tag}k{i}") == F.col(f"{tag}_{k}") for i, k in enumerate(keys)]
        return held.join(other, test, "left" if outer else kind).select(*have)

    joined = ObjectQuery(Node(node.data, node, f"{node.key}+{tag}", node.entity, extend, False, moves=False))
    return Rows(joined, tag, frame.columns), joined


class Split:
    """A query once for each value of a key: iterate for (value, query), call for all results."""

    def __init__(self, query: ObjectQuery, by: list[AttributeQuery], build: Callable[[ObjectQuery], Query] | None = None):
        self.query, self.by, self.build = query, by, build or (lambda q: q)

    def keys(self) -> Iterator[tuple]:
        columns = [[r[0] for r in k.to_df().distinct().orderBy(k.expression.name).toLocalIterator()] for k in self.by]
        return pairs(*columns)

    def then(self, build: Callable[[ObjectQuery], Query]) -> Split:
        """What to ask of the objects of each part."""
        before = self.build
        return Split(self.query, self.by, lambda q: build(before(q)))

    def part(self, values: tuple) -> Query:
        q = self.query
        for k, v in zip(self.by, values, strict=True):
            q = q._mask(combine([k], lambda c, v=v: c.eqNullSafe(F.lit(v)), f"key={v!r}"))
        return self.build(q)

    def __iter__(self) -> Iterator[tuple[tuple, Query]]:
        for values in self.keys():
            yield values, self.part(values)

    def __call__(self, **how) -> list:
        return [q(**how) for _, q in self]

    def to_df(self) -> DataFrame:
        """All parts in one job: the key columns beside those of a table."""
        built = self.build(self.query)
        if not isinstance(built, Table):
            raise TypeError("only tables can be split in one job")
        return Table(built.index, [*[(k.expression.name, k) for k in self.by], *built.columns]).to_df()


def split(query: ObjectQuery, *by: str | AttributeQuery | ObjectQuery) -> Split:
    """Split objects by attributes (their default attribute if none is named)."""
    keys = [query._resolve(k) if isinstance(k, str) else k._default() if isinstance(k, ObjectQuery) else k for k in by] or [query._default()]
    return Split(query, keys)


class Aligned:
    """Several branches side by side: any operation goes to all of them."""

    def __init__(self, members: dict[str, Query]):
        self.members = members

    def apply(self, function: Callable) -> Aligned:
        return Aligned({k: function(v) for k, v in self.members.items()})

    def __getattr__(self, name: str) -> Aligned:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.apply(lambda m: getattr(m, name))

    def __getitem__(self, item) -> Aligned:
        if isinstance(item, Aligned):
            return Aligned({k: v[item.members[k]] for k, v in self.members.items()})
        return self.apply(lambda m: m[item])

    def _with(self, other, op) -> Aligned:
        return Aligned({k: op(v, other.members[k] if isinstance(other, Aligned) else other) for k, v in self.members.items()})

    __hash__ = object.__hash__

    def items(self):
        """The members with their names."""
        return self.members.items()

    def __iter__(self):
        """Rows of the members side by side, as tuples; None where a member has no more."""
        return zip_longest(*[iter(m) for m in self.members.values()])

    def table(self, index: ObjectQuery | None = None) -> Table:
        """Columns ``key_name`` at the deepest common ancestor (or at ``index``)."""
        parts = {k: v.columns if isinstance(v, Table) else [(as_expression(v).name, v)] for k, v in self.members.items()}
        if index is None:
            nodes = [as_expression(q).node for c in parts.values() for _, q in c]
            common = next((n for n in reversed(nodes[0].chain) if all(m.under(n) for m in nodes)), None) if all(nodes) else None
            if common is None:
                raise DisjointPathError("the aligned queries share no ancestor")
            index = ObjectQuery(common)
        return Table(index, [(f"{k}_{name}", q) for k, c in parts.items() for name, q in c])

    def to_df(self) -> DataFrame:
        return self.table().to_df()

    def __call__(self, **how):
        return self.table()(**how)


def _forward(name: str, swapped: bool = False):
    op = getattr(operator, name)

    def method(self, other):
        return self._with(other, (lambda a, b: op(b, a)) if swapped else op)

    return method


for _name in ("add", "sub", "mul", "truediv", "pow", "and_", "or_", "xor", "eq", "ne", "lt", "le", "gt", "ge"):
    setattr(Aligned, f"__{_name.strip('_')}__", _forward(_name))
for _name in ("add", "sub", "mul", "truediv", "pow", "and_", "or_", "xor"):
    setattr(Aligned, f"__r{_name.strip('_')}__", _forward(_name, True))
for _name in ("neg", "pos", "abs", "invert"):
    setattr(Aligned, f"__{_name}__", lambda self, op=getattr(operator, _name): self.apply(op))


def align(*members: Query, **named: Query) -> Aligned:
    """Align branches under names, or numbers."""
    return Aligned({**{str(i): m for i, m in enumerate(members)}, **named})


def cross(objects: ObjectQuery, others: ObjectQuery) -> ObjectQuery:
    """All of ``others`` for each of ``objects``, which they have nothing to do with: a product, to be asked for by name."""
    left, right = objects.node, others.node

    def extend(df: DataFrame, outer: bool) -> DataFrame:
        return df.crossJoin(right.frame)

    node = Node(left.data, left, f"{left.key}x{right.key}", right.entity, extend)
    node.tag = right.tag
    return ObjectQuery(node)
