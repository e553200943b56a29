"""Lazy "for each" queries over objects, composed as DataFrames.

An object query is a path from the dataset: each step is a ``Node`` that knows
how to extend a frame of its parent's rows.  The frame of a node has a row for
every combination of objects on the path and holds the columns of all of them
under names derived from the node, so an attribute is a column reference and
Catalyst prunes what isn't used.  Aggregates are frames grouped by the identities
of the objects down to ``wrt``, joined back with a fill for empty groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.errors import AmbiguousPathError, AttributeNameError, CardinalityError, DisjointPathError
from orrery.plans.paths import Hop, find_paths
from orrery.plans.schema import Entity

#: Local lists and tables of up to this many rows are broadcast.
SMALL = 50_000
NUMBERS = (T.IntegralType, T.FractionalType)


def _tag(key: str) -> str:
    return hashlib.md5(key.encode()).hexdigest()[:10]


def join_lineage(df: DataFrame, other: DataFrame, ids: list[str], how: str) -> DataFrame:
    """Join on identities, of which a missing one equals a missing one; the columns of ``df`` stay, then come those of ``other``."""
    right = other.withColumnsRenamed({c: f"{c}_r" for c in ids})
    joined = df.join(right, [df[c].eqNullSafe(right[f"{c}_r"]) for c in ids], how)
    return joined.drop(*[f"{c}_r" for c in ids])


class Node:
    """One step of a path: an entity's objects, or the rows of the parent filtered or widened."""

    def __init__(self, data, parent: Node | None, key: str, entity: str | None, extend: Callable[[DataFrame | None, bool], DataFrame], singular: bool = False, moves: bool = True):
        self.data, self.parent, self.key, self.entity, self._extend = data, parent, key, entity, extend
        self.singular, self.moves = singular, moves
        #: Rows of this node with no more of its parent than the identity, if that is to be had without the parent's rows.
        self.rooted: Callable[[], DataFrame] | None = None
        self.tag = _tag(key) if moves else parent.tag

    @cached_property
    def chain(self) -> list[Node]:
        return [*(self.parent.chain if self.parent else []), self]

    @property
    def id(self) -> str:
        return f"{self.tag}_id"

    @property
    def place(self) -> str:
        """The column with an object's place in a list of identities, where it was asked for by one."""
        return f"{self.tag}__place"

    @cached_property
    def lineage(self) -> list[str]:
        """Identity columns of all objects on the path."""
        return list(dict.fromkeys(n.id for n in self.chain if n.entity))

    def column(self, attribute: str) -> str:
        return f"{self.tag}_{attribute}"

    def under(self, other: Node | None) -> bool:
        return other is None or any(n.key == other.key for n in self.chain)

    def single_below(self, other: Node) -> bool:
        """Whether each row of ``other`` has one of this at most."""
        if not self.under(other):
            return False
        at = next(i for i, n in enumerate(self.chain) if n.key == other.key)
        return all(n.singular for n in self.chain[at + 1 :])

    def extend(self, df: DataFrame, outer: bool = False) -> DataFrame:
        return self._extend(df, outer)

    @cached_property
    def frame(self) -> DataFrame:
        """One row per combination of existing objects on the path."""
        return self.extend(self.parent.frame if self.parent else None)

    def bare_frame(self, top: Node | None) -> DataFrame | None:
        """Rows with the identity of ``top`` but without its other columns or ancestors: no join with their rows.

        What lies below an object depends on the object alone, however it was come by.
        Rows whose parent isn't there belong to no row of ``top``, so they are lost when
        joined back.  None where masks above would be left out.
        """
        if top is None or not all(n.moves for n in top.chain):
            return None
        at = next((i for i, n in enumerate(self.chain) if n.key == top.key), None)
        if at is None or at + 1 >= len(self.chain) or self.chain[at + 1].rooted is None:
            return None
        df = self.chain[at + 1].rooted()
        for n in self.chain[at + 2 :]:
            df = n.extend(df)
        return df

    def rows_below(self, top: Node | None, make: Callable[[DataFrame, list[str]], DataFrame]) -> tuple[DataFrame, list[str]]:
        """What ``make`` makes of this node's rows and the columns that tell their object of ``top``; bare rows if they do."""
        ids = top.lineage if top else []
        try:
            bare = self.bare_frame(top)
            if bare is not None:
                return make(bare, [top.id]), [top.id]
        except AnalysisException:  # a value or a filter takes other columns of top, or of what is above it
            pass
        return make(self.frame, ids), ids

    def outer_frame(self, top: Node | None) -> DataFrame:
        """Rows of ``top``, with nulls where what is below doesn't exist or is masked."""
        df = top.frame if top else None
        at = next((i + 1 for i, n in enumerate(self.chain) if top is not None and n.key == top.key), 0)
        for n in self.chain[at:]:
            df = n.extend(df, n.parent is not None)
        return df


def _prefixed(data, entity: str, tag: str) -> DataFrame:
    df = data.frame(entity)
    return df.select(data.identity(entity).alias(f"{tag}_id"), *[F.col(f"`{c}`").alias(f"{tag}_{c}") for c in df.columns if not (entity_template(data, entity) and c == "_id")])


def entity_template(data, entity: str) -> bool:
    return data.registry.entities[entity].template


def start(data, name: str):
    """``data.<name>``: objects of a plural, or an attribute or relative of the entity that owns it."""
    registry = data.registry
    if found := registry.entity_named(name):
        entity, many = found
        if not many:
            raise CardinalityError(f"start from the plural: {entity.many}")
        return ObjectQuery(_scan(data, entity))
    if relatives := registry.relatives(name):
        if len({r.parent for r in relatives}) > 1:
            raise AmbiguousPathError(f"{name} belongs to several entities")
        return getattr(ObjectQuery(_scan(data, registry.entities[relatives[0].parent])), name)
    if found := registry.attribute_named(name):
        owners = registry.owners(found[0])
        if len(owners) != 1:
            raise AmbiguousPathError(f"{name} belongs to {', '.join(e.name for e in owners)}")
        return ObjectQuery(_scan(data, owners[0]))._own(found[0])
    raise registry.unknown(name)


def _scan(data, entity: Entity) -> Node:
    key = f"scan({entity.name})"

    def extend(df: DataFrame | None, outer: bool) -> DataFrame:
        own = _prefixed(data, entity.name, _tag(key))
        return own if df is None else df.crossJoin(own)

    return Node(data, None, key, entity.name, extend)


def _link(hop: Hop, data, left: str, right: str, df: DataFrame, target: DataFrame, how: str) -> DataFrame:
    """Join a frame's objects (prefix ``left``) with a target frame (prefix ``right``) along one relation."""
    r = hop.relation
    if r.edges is not None:
        edges = r.edges(data)
        a, b = ("dst", "src") if hop.up else ("src", "dst")
        edge = edges.select(F.col(a).alias(f"{right}_from"), F.col(b).alias(f"{right}_to"))
        both = edge.join(target, edge[f"{right}_to"] == target[f"{right}_id"], "inner").drop(f"{right}_to")
        return df.join(both, df[f"{left}_id"] == both[f"{right}_from"], how).drop(f"{right}_from")
    parent_columns = r.parent_columns or data.registry.entities[r.parent].identity
    pairs = [(c, p) if hop.up else (p, c) for c, p in zip(r.columns, parent_columns, strict=True)]
    return df.join(target, [df[f"{left}_{a}"] == target[f"{right}_{b}"] for a, b in pairs], how)


def _rooted(data, parent: Node, path: list[Hop], entity: str, tag: str) -> Callable[[], DataFrame] | None:
    """Along a path that begins with rows that hold the parent's identity, without the parent's rows."""
    hop, last = path[0], len(path) == 1
    r, identity = hop.relation, data.registry.entities[parent.entity].identity
    if hop.up or r.edges is not None or len(identity) != 1 or r.parent != parent.entity or tuple(r.parent_columns or identity) != tuple(identity):
        return None
    right = tag if last else f"{tag}v0"

    def rows() -> DataFrame:
        target = _prefixed(data, entity if last else hop.target, right)
        key = F.col(f"{right}_{r.columns[0]}")
        df = target.where(key.isNotNull()).withColumn(parent.id, key)
        return df if last else _walk(data, df, right, path[1:], entity, tag, "inner", 1).drop(*target.columns)

    return rows


def _walk(data, df: DataFrame, left: str, path: list[Hop], entity: str, tag: str, how: str, first: int = 0) -> DataFrame:
    """Along a path; objects between its ends are dropped at the end."""
    between = []
    for i, hop in enumerate(path, first):
        last = i + 1 == len(path) + first
        right = tag if last else f"{tag}v{i}"
        target = _prefixed(data, entity if last else hop.target, right)
        df = _link(hop, data, left, right, df, target, how)
        if not last:
            between += target.columns
        left = right
    return df.drop(*between)


def _traverse(parent: Node, paths: list[list[Hop]], entity: Entity, label: str) -> Node:
    key = f"{parent.key}.{label}"
    tag, data = _tag(key), parent.data

    def extend(df: DataFrame, outer: bool) -> DataFrame:
        how = "left" if outer else "inner"
        if len(paths) == 1:
            return _walk(data, df, parent.tag, paths[0], entity.name, tag, how)
        # a template forks: one branch for each concrete entity
        branches = []
        for path in paths:
            part = _walk(data, df, parent.tag, path, path[-1].target, tag, "inner")
            own = [c for c in _prefixed(data, entity.name, tag).columns if c in part.columns]
            kind = F.lit(path[-1].target)
            ident = F.struct(kind.alias("_type"), F.col(f"{tag}_id").cast("string").alias("_id")) if not entity.identity else F.col(f"{tag}_id")
            branches.append(part.select(*df.columns, ident.alias(f"{tag}_id"), *[c for c in own if c != f"{tag}_id"], kind.alias(f"{tag}__type")))
        below = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches)
        if not outer:
            return below
        on = [c for c in df.columns if c.endswith("_id") and c in parent.lineage]
        return df.join(below.drop(*[c for c in df.columns if c not in on]), on, "left")

    singular = len(paths) == 1 and all(h.singular for h in paths[0])
    node = Node(data, parent, key, entity.name, extend, singular)
    if len(paths) == 1 and not data.registry.entities[paths[0][0].target].template:
        node.rooted = _rooted(data, parent, paths[0], entity.name, tag)
    return node


@dataclass(frozen=True, eq=False)
class Aggregate:
    """A grouped value to be joined back onto rows that hold the lineage of ``wrt``."""

    name: str
    wrt: Node | None
    item: Expression
    make: Callable[[Column], Column]
    fill: object = None
    nulls: bool = False

    @property
    def rows(self) -> tuple:
        """What aggregates must have in common to be made in one go."""
        return (self.item.node.key if self.item.node else None, self.wrt.key if self.wrt else None, self.nulls)


def _grouped(members: list[Aggregate]) -> tuple[DataFrame, list[str]]:
    """Aggregates of the same rows in one grouping, and the columns that it is grouped by."""
    node, top = members[0].item.node, members[0].wrt

    def made(rows: DataFrame | None, ids: list[str]) -> DataFrame:
        for m in members:
            rows = m.item.on(m.item.frame() if rows is None else rows, node)
        values = [m.make(m.item.column).alias(m.name) for m in members]
        return rows.agg(*values) if top is None else rows.groupBy(*ids).agg(*values)

    if node is None:
        return made(None, []), []
    if members[0].nulls:
        ids = top.lineage if top else []
        return made(node.outer_frame(top), ids), ids
    return node.rows_below(top, made)


def attach(df: DataFrame, base: Node | None, needs: Iterable) -> DataFrame:
    """Rows of ``base`` with other levels (nodes) and aggregates joined on; aggregates of the same rows share one grouping."""
    needs = list(dict.fromkeys(needs))
    for need in needs:
        if not isinstance(need, Aggregate):
            df = _reach(df, base, need)
        elif need.wrt is not None and base is not None and not set(need.wrt.lineage) <= set(df.columns):
            df = _reach(df, base, need.wrt)
    together: dict[tuple, dict[str, Aggregate]] = {}
    for need in needs:
        if isinstance(need, Aggregate) and need.name not in df.columns:
            together.setdefault(need.rows, {})[need.name] = need
    for members in together.values():
        own, ids = _grouped(list(members.values()))
        if not ids:
            df = df.crossJoin(F.broadcast(own))  # one row
            continue
        df = join_lineage(df, own, ids, "left")
        fills = {m.name: m.fill if isinstance(m.fill, Column) else F.lit(m.fill) for m in members.values() if m.fill is not None}
        df = df.withColumns({name: F.coalesce(F.col(name), fill) for name, fill in fills.items()}) if fills else df
    return df


class Expression:
    """A value for each row of a node: ``AttributeQuery`` in the making."""

    def __init__(self, node: Node | None, column: Column, key: str, needs: tuple = (), product: bool = False, name: str = "value"):
        self.node, self.column, self.key, self.needs, self.product, self.name = node, column, key, needs, product, name

    @property
    def data(self):
        """The dataset behind this."""
        return self.node.data if self.node is not None else next(n.item.data if isinstance(n, Aggregate) else n.data for n in self.needs)

    def on(self, df: DataFrame, base: Node | None) -> DataFrame:
        """``df`` (rows of ``base``) with everything this needs."""
        return attach(df, base, self.needs)

    @cached_property
    def type(self) -> T.DataType:
        return self.on(self.frame(), self.node).select(self.column.alias("x")).schema["x"].dataType

    def frame(self) -> DataFrame:
        if self.node is not None:
            return self.node.frame
        data = next(n.item.data for n in self.needs if isinstance(n, Aggregate))
        return data.spark.range(1).select()


def _reach(df: DataFrame, base: Node | None, node: Node) -> DataFrame:
    """Extend rows of ``base`` to a node that is at most one for each of them."""
    missing = []
    for n in reversed(node.chain):
        if n.id in df.columns and n.moves or base is not None and n.key == base.key:
            break
        missing.append(n)
    for n in reversed(missing):
        if n.moves and not n.singular:
            raise DisjointPathError(f"{n.entity} is plural here; aggregate it first")
        df = n.extend(df, True)
    return df


def _literal(x) -> Expression:
    return Expression(None, x if isinstance(x, Column) else F.lit(x), f"lit({x!r})")


def as_expression(x) -> Expression:
    if isinstance(x, AttributeQuery):
        return x.expression
    if isinstance(x, ObjectQuery):
        return x._default().expression
    return x if isinstance(x, Expression) else _literal(x)


def combine(operands: list, make: Callable[..., Column], key: str, name: str = "value") -> AttributeQuery:
    """An expression over operands at the same or at nested levels; it lives at the deepest."""
    parts = [as_expression(x) for x in operands]
    if any(p.product for p in parts):
        raise TypeError("products are arrays outside the tables: read them before calculating with them")
    nodes = [p.node for p in parts if p.node is not None]
    base = max(nodes, key=lambda n: len(n.chain), default=None)
    needs: list = []
    for p in parts:
        if p.node is not None and not base.under(p.node):
            if not any(base.under(a) and p.node.single_below(a) for a in p.node.chain):
                raise DisjointPathError("operands share no level; aggregate one of them with respect to a common ancestor")
            needs.append(p.node)
        needs += p.needs
    data = next((x.data for x in operands if isinstance(x, Query)), None)
    label = f"{key}({','.join(p.key + '@' + (p.node.key if p.node else '') for p in parts)})"
    return AttributeQuery(data, Expression(base, make(*[p.column for p in parts]), label, tuple(dict.fromkeys(needs)), name=name))


class Query:
    """What all queries share: running, and nothing more."""

    data = None

    def to_df(self) -> DataFrame:
        raise NotImplementedError

    def __call__(self, limit: int | None = 1000, skip: int = 0, distinct: bool = False):
        from orrery.operators.results import collect

        return collect(self, limit, skip, distinct)

    def __iter__(self):
        return self.to_df().toLocalIterator()

    def explain(self) -> None:
        self.to_df().explain("formatted")


class ObjectQuery(Query):
    """Objects of an entity for each object above them."""

    def __init__(self, node: Node, rows: Node | None = None):
        self.node, self.data, self._rows = node, node.data, rows

    # --- names -------------------------------------------------------------
    @property
    def _entity(self) -> Entity:
        return self.data.registry.entities[self.node.entity]

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return self._resolve(name)

    def _resolve(self, name: str):
        registry = self.data.registry
        if name in self._entity.attributes or name in self._entity.products:
            return self._own(name)
        if relatives := self._relatives(name):
            return self._relative(relatives[0], name)
        if found := registry.entity_named(name):
            return self._to(found[0], found[1], name)
        if found := registry.attribute_named(name):
            return self._indirect(*found)
        if name == "id":
            return AttributeQuery(self.data, Expression(self.node, F.col(self.node.id), "id", name="id"))
        raise registry.unknown(name)

    def _own(self, name: str) -> AttributeQuery:
        product = name in self._entity.products
        return AttributeQuery(self.data, Expression(self.node, F.col(self.node.column(name)), name, product=product, name=name))

    def _relatives(self, name: str) -> list:
        kinds = {self.node.entity, self._entity.is_a}
        return [r for r in self.data.registry.relatives(name) if r.parent in kinds or r.child in kinds]

    def _relative(self, relation, name: str) -> ObjectQuery:
        up = relation.child == self.node.entity and relation.parent != self.node.entity
        target = relation.parent if up else relation.child
        return ObjectQuery(_traverse(self.node, [[Hop(relation, up, self.node.entity, target)]], self.data.registry.entities[target], f"relative({name})"))

    def _to(self, entity: Entity, many: bool, name: str) -> ObjectQuery:
        paths = find_paths(self.data.registry, self.node.entity, entity.name, singular=not many)
        if many and len(paths) == 1 and all(h.singular for h in paths[0]):
            raise CardinalityError(f"there is one {entity.single} for each {self._entity.single}: write {entity.single}")
        return ObjectQuery(_traverse(self.node, paths, entity, entity.name))

    def _indirect(self, attribute: str, many: bool) -> AttributeQuery:
        """An attribute of another entity; a singular one keeps this object as its row."""
        found, seen = [], []
        for owner in self.data.registry.owners(attribute):
            try:
                paths = find_paths(self.data.registry, self.node.entity, owner.name, singular=not many)
                found.append((sum(h.weight for h in paths[0]), len(paths[0]), owner))
            except (DisjointPathError, CardinalityError) as e:
                seen.append(e)
        if not found:
            raise next((e for e in seen if isinstance(e, CardinalityError)), DisjointPathError(f"no path leads to an owner of {attribute}"))
        found.sort(key=lambda x: x[:2])
        if len(found) > 1 and found[0][:2] == found[1][:2]:
            raise AmbiguousPathError(f"{attribute} belongs to {found[0][2].name} and {found[1][2].name}")
        owner = found[0][2]
        below = self._to(owner, many, owner.name)._own(attribute).expression
        if many:
            return AttributeQuery(self.data, below)
        return AttributeQuery(self.data, Expression(self.node, below.column, f"{owner.name}.{attribute}", (below.node,), below.product, attribute))

    def _default(self) -> AttributeQuery:
        e = self._entity
        name = e.default or (e.identity[0] if len(e.identity) == 1 else None) or (e.attributes[0] if len(e.attributes) == 1 else None) or ("value" if "value" in e.attributes else None)
        return self._own(name) if name else self.id

    # --- selection ---------------------------------------------------------
    def __getitem__(self, item):
        from orrery.operators.tables import Table

        if isinstance(item, AttributeQuery):
            return self._mask(item)
        if isinstance(item, str) and item in ("*", "**"):
            return Table(self, [(a, self._own(a)) for a in (*self._entity.attributes, *self._entity.products)])
        if isinstance(item, str):
            try:
                return self._resolve(item)
            except AttributeNameError:
                if self._id_type() == "string":
                    return self._ids([item], single=True)
                raise
        if isinstance(item, slice):
            return self._slice(item)
        if isinstance(item, list | tuple) and item and not any(isinstance(x, str | Query | dict) for x in item):
            return self._ids(list(item))
        if isinstance(item, dict):
            item = [item]
        if isinstance(item, Iterable) and not isinstance(item, Query):
            return Table.of(self, list(item))
        return self._ids([item], single=True)

    def _id_type(self) -> str:
        return dict(self.data.frame(self.node.entity).select(self.data.identity(self.node.entity).alias("i")).dtypes)["i"]

    def _mask(self, mask: AttributeQuery) -> ObjectQuery:
        e = mask.expression
        if not isinstance(e.type, T.BooleanType):
            raise TypeError("a filter must be boolean")
        node = self.node
        if e.node is not None and not (node.under(e.node) or e.node.single_below(node) or any(node.under(a) and e.node.single_below(a) for a in e.node.chain)):
            raise DisjointPathError("the filter isn't at or above the objects it filters")

        semi = mask.semi if mask.semi and node.under(mask.semi[1]) else None

        def extend(df: DataFrame, outer: bool) -> DataFrame:
            have = df.columns
            if semi and not outer:
                below, wrt, how = semi
                rows, ids = below.rows_below(wrt, lambda rows, ids: rows.select(*ids))
                return join_lineage(df, rows, ids, how).select(*have)
            held = e.on(df if e.node is None or e.node.id in df.columns else _reach(df, node, e.node), node)
            if not outer:
                return held.where(e.column).select(*have)
            own = [c for c in have if c.startswith(node.tag + "_")]
            return held.select(*[F.when(e.column, F.col(c)).alias(c) if c in own else F.col(c) for c in have])

        return ObjectQuery(Node(self.data, node, f"{node.key}[{e.key}]", node.entity, extend, True, moves=False), self._rows)

    def _ids(self, ids: list, single: bool = False) -> ObjectQuery:
        node, spark = self.node, self.data.spark
        kind = self._id_type()

        def extend(df: DataFrame, outer: bool) -> DataFrame:
            if single:
                hit = F.col(node.id) == F.lit(ids[0]).cast(kind)
                if outer:
                    own = [c for c in df.columns if c.startswith(node.tag + "_")]
                    return df.select(*[F.when(hit, F.col(c)).alias(c) if c in own else F.col(c) for c in df.columns])
                return df.where(hit)
            wanted = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], f"`{node.id}` {kind}, `{node.place}` int")
            wanted = F.broadcast(wanted) if len(ids) <= SMALL else wanted
            return df.join(wanted, node.id, "inner")

        return ObjectQuery(Node(self.data, node, f"{node.key}[ids {ids!r}]", node.entity, extend, single, moves=False), self._rows)

    def of_type(self, entity: str) -> ObjectQuery:
        """The objects of a template that are of one of the entities that extend it."""
        if not self._entity.template or entity not in self.data.registry.subclasses(self.node.entity):
            raise TypeError(f"{entity} doesn't extend {self.node.entity}")
        kind = Expression(self.node, F.col(self.node.column("_type")) == entity, f"type={entity}")
        return self._mask(AttributeQuery(self.data, kind))

    def _slice(self, s: slice) -> ObjectQuery:
        """The first objects of each parent, in the order of their identity."""
        from pyspark.sql import Window

        if s.step not in (None, 1) or (s.start or 0) < 0 or (s.stop or 0) < 0:
            raise ValueError("slices go forwards, one by one, from the first")
        node = self.node
        above = [c for c in node.lineage if c != node.id]

        def extend(df: DataFrame, outer: bool) -> DataFrame:
            n = F.row_number().over(Window.partitionBy(*above).orderBy(node.id))
            ok = (n > (s.start or 0)) & ((n <= s.stop) if s.stop is not None else F.lit(True))
            return df.withColumn("_n", ok).where("_n").drop("_n")

        return ObjectQuery(Node(self.data, node, f"{node.key}[{s}]", node.entity, extend, True, moves=False), self._rows)

    # --- comparison and running ---------------------------------------------
    def __eq__(self, other):
        return self._default() == other

    def __ne__(self, other):
        return self._default() != other

    __hash__ = object.__hash__

    def _no_arithmetic(self, *_):
        raise TypeError("objects can't be calculated with: choose an attribute")

    __add__ = __sub__ = __mul__ = __truediv__ = __radd__ = __rsub__ = __rmul__ = __rtruediv__ = __pow__ = __neg__ = _no_arithmetic

    def to_df(self) -> DataFrame:
        return self._default().to_df()

    def __dir__(self) -> list[str]:
        return [*super().__dir__(), *self.data.registry.names()]


class AttributeQuery(Query):
    """A value for each object of a level."""

    def __init__(self, data, expression: Expression, semi: tuple | None = None):
        # semi: (node, wrt, join) of an existence test, which as a filter is a semi or anti join
        self.data, self.expression, self.semi = data, expression, semi

    @property
    def node(self) -> Node | None:
        return self.expression.node

    @property
    def type(self) -> T.DataType:
        return self.expression.type

    def alias(self, name: str) -> AttributeQuery:
        e = self.expression
        return AttributeQuery(self.data, Expression(e.node, e.column, e.key, e.needs, e.product, name))

    def to_df(self) -> DataFrame:
        """One column, without nulls that stand for missing objects."""
        e = self.expression
        df = e.on(e.frame(), e.node)
        return df.select(e.column.alias(e.name)).where(F.col(e.name).isNotNull())

    def __getitem__(self, mask: AttributeQuery) -> AttributeQuery:
        if not isinstance(as_expression(mask).type, T.BooleanType):
            raise TypeError("a filter must be boolean")
        return combine([self, mask], lambda x, m: F.when(m, x), "where", self.expression.name)

    def _is(self, *kinds) -> bool:
        return isinstance(self.type, kinds)

    def _two(self, other, make, key, swap=False) -> AttributeQuery:
        return combine([other, self] if swap else [self, other], make, key)

    def _compare(self, other, make, key) -> AttributeQuery:
        left, right = self.type, as_expression(other).type if isinstance(other, Query) else None
        text, number = isinstance(left, T.StringType), isinstance(left, NUMBERS)
        other_number = isinstance(right, NUMBERS) if right is not None else isinstance(other, int | float) and not isinstance(other, bool)
        other_text = isinstance(right, T.StringType) if right is not None else isinstance(other, str)
        if text and other_number or number and other_text:
            raise TypeError("text can't be compared with numbers")
        return self._two(other, make, key)

    def _pattern(self, other) -> str | None:
        """The regular expression that a text stands for: /re/, or one that holds a star and no quotes around it."""
        if not isinstance(other, str):
            return None
        if len(other) > 1 and other[0] == other[-1] == "/":
            return other[1:-1]
        if "*" in other and not (len(other) > 1 and other[0] == other[-1] == '"'):
            return other
        return None

    def _text(self, other):
        return other[1:-1] if isinstance(other, str) and len(other) > 1 and other[0] == other[-1] == '"' else other

    def __eq__(self, other):
        if (p := self._pattern(other)) is not None:
            return self._two(f"^(?:{p})$", lambda a, b: a.rlike(f"^(?:{p})$"), "matches")
        return self._compare(self._text(other), lambda a, b: a == b, "eq")

    def __ne__(self, other):
        if (p := self._pattern(other)) is not None:
            return self._two(f"^(?:{p})$", lambda a, b: ~a.rlike(f"^(?:{p})$"), "differs")
        return self._compare(self._text(other), lambda a, b: a != b, "ne")

    __hash__ = object.__hash__

    def __lt__(self, other):
        return self._compare(other, lambda a, b: a < b, "lt")

    def __le__(self, other):
        return self._compare(other, lambda a, b: a <= b, "le")

    def __gt__(self, other):
        return self._compare(other, lambda a, b: a > b, "gt")

    def __ge__(self, other):
        return self._compare(other, lambda a, b: a >= b, "ge")

    def _logic(self, other, bits, truth, key) -> AttributeQuery:
        both = self._is(T.IntegralType) and (isinstance(as_expression(other).type, T.IntegralType) if isinstance(other, Query) else isinstance(other, int) and not isinstance(other, bool))
        return self._two(other, bits if both else lambda a, b: truth(a.cast("boolean"), b.cast("boolean")), key)

    def __and__(self, other):
        return self._logic(other, lambda a, b: a.bitwiseAND(b), lambda a, b: a & b, "and")

    def __or__(self, other):
        return self._logic(other, lambda a, b: a.bitwiseOR(b), lambda a, b: a | b, "or")

    def __xor__(self, other):
        return self._logic(other, lambda a, b: a.bitwiseXOR(b), lambda a, b: a != b, "xor")

    __rand__, __ror__, __rxor__ = __and__, __or__, __xor__

    def __invert__(self):
        out = combine([self], lambda a: ~a.cast("boolean"), "not")
        if self.semi:
            node, wrt, how = self.semi
            out.semi = (node, wrt, "left_anti" if how == "left_semi" else "left_semi")
        return out

    def __add__(self, other):
        text = self._is(T.StringType)
        return self._two(other, (lambda a, b: F.concat(a, b.cast("string"))) if text else (lambda a, b: a + b), "add")

    def __radd__(self, other):
        text = self._is(T.StringType)
        return self._two(other, (lambda a, b: F.concat(a.cast("string"), b)) if text else (lambda a, b: a + b), "add", swap=True)

    def __sub__(self, other):
        return self._two(other, lambda a, b: a - b, "sub")

    def __rsub__(self, other):
        return self._two(other, lambda a, b: a - b, "sub", swap=True)

    def __mul__(self, other):
        return self._two(other, lambda a, b: a * b, "mul")

    def __rmul__(self, other):
        return self._two(other, lambda a, b: a * b, "mul", swap=True)

    def __truediv__(self, other):
        return self._two(other, lambda a, b: F.try_divide(a.cast("double"), b.cast("double")), "div")

    def __rtruediv__(self, other):
        return self._two(other, lambda a, b: F.try_divide(a.cast("double"), b.cast("double")), "div", swap=True)

    def __pow__(self, other):
        return self._two(other, F.pow, "pow")

    def __rpow__(self, other):
        return self._two(other, F.pow, "pow", swap=True)

    def __neg__(self):
        return combine([self], lambda a: -a, "neg")

    def __pos__(self):
        return self

    def __abs__(self):
        return combine([self], F.abs, "abs")

    def __round__(self, n=0):
        return combine([self], lambda a: F.round(a, n), f"round{n}")

    def __floor__(self):
        return combine([self], F.floor, "floor")

    def __ceil__(self):
        return combine([self], F.ceil, "ceil")

    def __bool__(self):
        raise TypeError("a query has no truth value: combine masks with & | ^ ~")
