"""Tables designed from queries: one row per object of the index, columns of any level.

A column at or above the index, or singular below it, is a plain column.  A
plural column is a list for each row, collected once for all columns of the same
objects as sorted structs, so that sibling lists stay aligned.  A column that has
nothing to do with the index is the same list in every row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.errors import AttributeNameError, DisjointPathError
from orrery.naming import suggest
from orrery.operators.query import AttributeQuery, Node, ObjectQuery, Query, _tag, as_expression, attach, join_lineage


#: Values of a list that stands unchanged in every row.
WIDEST_LIST = 10_000


class Table(Query):
    """Named columns for each object of ``index``."""

    def __init__(self, index: ObjectQuery, columns: list[tuple[str, AttributeQuery]]):
        self.index, self.columns, self.data = index, columns, index.data

    @staticmethod
    def of(index: ObjectQuery, items: Iterable) -> Table:
        """From names, queries, {name: query}, tables and {prefix_ or _suffix: table}."""
        columns: list[tuple[str, AttributeQuery]] = []

        def add(item, name: str | None = None) -> None:
            if isinstance(item, str):
                got = index[item] if item in ("*", "**") else index._resolve(item)
                add(got, name or (None if isinstance(got, Table) else item))
            elif isinstance(item, dict):
                for k, v in item.items():
                    add(index._resolve(v) if isinstance(v, str) else v, k)
            elif isinstance(item, Table):
                for k, v in item.columns:
                    columns.append((k if name is None else name + k if name.endswith("_") else k + name, v))
            elif isinstance(item, ObjectQuery):
                add(item._default(), name)
            elif isinstance(item, AttributeQuery):
                columns.append((name or item.expression.name, item))
            else:
                raise TypeError(f"a column can't be made of {item!r}")

        for item in items:
            add(item)
        return Table(index, columns)

    def __add__(self, other: Table) -> Table:
        if other.index.node.key != self.index.node.key:
            raise ValueError("only tables of the same objects can be put side by side")
        if twice := {k for k, _ in self.columns} & {k for k, _ in other.columns}:
            raise ValueError(f"both tables have {sorted(twice)}")
        return Table(self.index, self.columns + other.columns)

    def __getitem__(self, name: str) -> AttributeQuery:
        held = {k: v for k, (_, v) in zip(self.names(), self.columns, strict=True)}
        if name not in held:
            raise AttributeNameError(f"no column {name}; near it: {', '.join(suggest(name, held))}")
        return held[name]

    def names(self) -> list[str]:
        """Column names; those that occur more than once get a number that makes them unlike all others."""
        seen = Counter(k for k, _ in self.columns)
        taken, nth, out = set(seen), Counter(), []
        for k, _ in self.columns:
            name = k
            while seen[k] > 1 and name in taken:
                name = f"{k}{nth[k]}"
                nth[k] += 1
            taken.add(name)
            out.append(name)
        return out

    def _singular(self, node: Node | None) -> bool:
        own = self.index.node
        return node is None or own.under(node) or any(own.under(a) and node.single_below(a) for a in node.chain)

    def to_df(self) -> DataFrame:
        own = self.index.node
        out, lists = [], {}
        single = [e for e in (as_expression(q) for _, q in self.columns) if self._singular(e.node)]
        df = attach(own.frame, own, [need for e in single for need in e.needs])
        for name, query in zip(self.names(), (q for _, q in self.columns), strict=True):
            e = as_expression(query)
            if self._singular(e.node):
                df = e.on(df, own)
                if e.node is not None and e.node.id not in df.columns:
                    df = attach(df, own, [e.node])
                if e.node is not None and not own.under(e.node):
                    df = _masked_to(df, own, e.node)
                out.append((name, e.column))
            else:
                lists.setdefault(e.node.key, []).append((name, e))
                out.append((name, None))
        held = {}
        for key, members in lists.items():
            node = members[0][1].node
            shared = next((a for a in reversed(own.chain) if node.under(a)), None)
            column = "l" + _tag(key)
            ids = [c for c in node.lineage if shared is None or c not in shared.lineage]

            def packed(rows: DataFrame, by: list[str], node=node, members=members, column=column, ids=ids) -> DataFrame:
                for _, e in members:
                    rows = e.on(rows, node)
                struct = F.struct(*[F.col(c).alias(f"i{i}") for i, c in enumerate(ids)], *[e.column.alias(f"c{i}") for i, (_, e) in enumerate(members)])
                return rows.groupBy(*by).agg(F.array_sort(F.collect_list(struct)).alias(column))

            if shared is None:
                if node.frame.limit(WIDEST_LIST + 1).count() > WIDEST_LIST:
                    raise DisjointPathError(f"{', '.join(name for name, _ in members)} has nothing to do with the rows and more than {WIDEST_LIST} values: join it by a key, or aggregate it")
                df = df.crossJoin(F.broadcast(packed(node.frame, [])))  # one row
            else:
                own_rows, by = node.rows_below(shared, packed)
                df = join_lineage(df, own_rows, by, "left")
            for i, (name, e) in enumerate(members):
                values = F.col(f"{column}.c{i}")
                held[name] = F.coalesce(values, F.array().cast(f"array<{e.type.simpleString()}>"))
        return df.select(*[(held[name] if c is None else c).alias(name) for name, c in out])


def _masked_to(df: DataFrame, own: Node, node: Node) -> DataFrame:
    """Masks on a singular step below the index set its columns to null where they don't hold."""
    at = len([n for n in node.chain if own.under(n)])
    for n in node.chain[at:]:
        if not n.moves:
            df = n.extend(df, True)
    return df
