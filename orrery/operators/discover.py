"""What a dataset offers: names, attributes, objects, explanations, and patterns of objects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.errors import CardinalityError, DisjointPathError
from orrery.naming import plural, suggest
from orrery.operators.query import Node, ObjectQuery, join_lineage
from orrery.plans.paths import find_paths


def find(source, name: str, n: int = 10) -> list[str]:
    """The names of a dataset (or of the dataset of a query) that are most like ``name``."""
    return suggest(name, _registry(source).names(), n)


def attributes(query: ObjectQuery, many: bool | None = None, own: bool = False) -> list[str]:
    """Attributes that a query can reach: as singular or plural names, or only those of its own objects."""
    registry = query.data.registry
    entity = registry.entities[query.node.entity]
    out = set() if many else {*entity.attributes, *entity.products}
    if not own:
        for name, e in registry.entities.items():
            for single in (True, False):
                if name != entity.name and many in (None, not single) and _reaches(registry, entity.name, name, single):
                    out |= {a if single else plural(a) for a in (*e.attributes, *e.products)}
    return sorted(out)


def objects(query: ObjectQuery, many: bool | None = None) -> list[str]:
    """Objects that a query can reach, by the name that fits their number."""
    registry, out = query.data.registry, set()
    for name, e in registry.entities.items():
        if name == query.node.entity:
            continue
        if _reaches(registry, query.node.entity, name, True):
            out |= {e.single} if many in (None, False) else set()
        elif many in (None, True) and _reaches(registry, query.node.entity, name, False):
            out.add(e.many)
    return sorted(out)


def explain(query: ObjectQuery) -> str:
    """What an entity is, how it is identified and what it is related to."""
    registry = query.data.registry
    e = registry.entities[query.node.entity]
    lines = [f"{e.name}: {e.doc}".rstrip(": "), f"identity: {', '.join(e.identity) or 'that of what extends it'}", f"attributes: {', '.join(e.attributes)}"]
    lines += [f"{r.child} -> {r.parent}" + f" ({r.name})" * bool(r.name) for r in registry.relations if e.name in (r.parent, r.child)]
    return "\n".join(lines)


def _registry(source):
    return source.registry if hasattr(source, "registry") and not isinstance(source, ObjectQuery) else source.data.registry


def _reaches(registry, start: str, goal: str, single: bool) -> bool:
    try:
        find_paths(registry, start, goal, singular=single)
    except (DisjointPathError, CardinalityError):
        return False
    return True


def match(df: DataFrame, **values) -> DataFrame:
    """Rows with given values; None matches null."""
    return df.where(reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in values.items()], F.lit(True)))


def match_edges(edges: DataFrame, src=None, dst=None, **values) -> DataFrame:
    """Edges by their ends and properties."""
    ends = {k: v for k, v in (("src", src), ("dst", dst)) if v is not None}
    return match(edges, **ends, **values)


def related_to_all(edges: DataFrame, of: str, to: str, wanted: DataFrame, exactly: bool = False) -> DataFrame:
    """Objects (column ``of``) related to every one of ``wanted`` (column ``to``); ``exactly``: and to no other.

    Relational division by counting: the wanted set is broadcast only as its size, one row.
    """
    need = wanted.select(to).distinct()
    pairs = edges.select(of, to).distinct()
    total = pairs.groupBy(of).agg(F.count("*").alias("_all"))
    hits = pairs.join(need, to).groupBy(of).agg(F.count("*").alias("_hit"))
    size = need.agg(F.count("*").alias("_n"))
    found = hits.join(total, of).crossJoin(F.broadcast(size)).where("_hit = _n")
    return (found.where("_all = _n") if exactly else found).select(of)


def pattern(objects_: ObjectQuery, related: list[ObjectQuery] = (), unrelated: list[ObjectQuery] = ()) -> ObjectQuery:
    """The objects that are related to every object of each query in ``related`` and to none of those in ``unrelated``.

    The queries may be of parents or of children, on any path that the names infer.
    A set to be had as a whole is counted, not listed: what is joined is one row.
    """
    node = objects_.node

    def hits(q: ObjectQuery) -> tuple[DataFrame, DataFrame]:
        found = q.node.frame.select(F.col(q.node.id).alias("_wanted")).distinct()
        to = _any_path(objects_, q.node.entity).node
        pairs = to.frame.select(*node.lineage, F.col(to.id).alias("_wanted")).distinct()
        return pairs.join(found, "_wanted", "left_semi"), found.agg(F.count("*").alias("_size"))

    def extend(df: DataFrame, outer: bool) -> DataFrame:
        if outer:
            raise DisjointPathError("a pattern chooses objects that exist; choose them first")
        for q in related:
            pairs, size = hits(q)
            whole = pairs.groupBy(*node.lineage).agg(F.count("*").alias("_n")).crossJoin(F.broadcast(size)).where("_n = _size")
            df = join_lineage(df, whole.select(*node.lineage), node.lineage, "left_semi")
        for q in unrelated:
            df = join_lineage(df, hits(q)[0].select(*node.lineage), node.lineage, "left_anti")
        return df

    key = f"{node.key}[related {[q.node.key for q in related]} unrelated {[q.node.key for q in unrelated]}]"
    return ObjectQuery(Node(node.data, node, key, node.entity, extend, True, moves=False))


def _any_path(query: ObjectQuery, entity: str) -> ObjectQuery:
    """The related objects of an entity, one or many."""
    found = query.data.registry.entities[entity]
    single = _reaches(query.data.registry, query.node.entity, entity, True)
    return query._to(found, not single, entity)


def without(objects_: DataFrame, edges: DataFrame, of: str) -> DataFrame:
    """Objects that have none of the edges."""
    return objects_.join(edges.select(of).distinct(), of, "left_anti")


def branch(*links: DataFrame) -> DataFrame:
    """Chains of edges: each frame's dst is the next one's src; one row per chain, ends n0, n1, ..."""
    out = links[0].select(F.col("src").alias("n0"), F.col("dst").alias("n1"))
    for i, link in enumerate(links[1:], 1):
        out = out.join(link.select(F.col("src").alias(f"n{i}"), F.col("dst").alias(f"n{i + 1}")), f"n{i}")
    return out.select(*[f"n{i}" for i in range(len(links) + 1)])
