"""Checks of stored data against the declared schema; each returns the offending rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.plans.schema import Relation


def cardinality(parents: DataFrame, children: DataFrame, parent_key: list[str], child_key: list[str], minimum: int = 0, maximum: int | None = None) -> DataFrame:
    """Parents whose number of children (``n``) is out of bounds."""
    n = children.groupBy(*[F.col(c).alias(p) for c, p in zip(child_key, parent_key, strict=True)]).agg(F.count("*").alias("n"))
    counted = parents.select(*parent_key).join(n, parent_key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    over = F.lit(False) if maximum is None else F.col("n") > maximum
    return counted.where((F.col("n") < minimum) | over)


def relation(data, r: Relation) -> DataFrame:
    """Children of a declared relation with too few or too many parents (``n``)."""
    child, parent = data.frame(r.child), data.frame(r.parent)
    keys = r.parent_columns or data.registry.entities[r.parent].identity
    ids = data.registry.entities[r.child].identity
    found = parent.select(*[F.col(k).alias(f"_{c}") for k, c in zip(keys, r.columns, strict=True)])
    test = [F.col(c) == F.col(f"_{c}") for c in r.columns]
    n = child.join(found, test, "left").groupBy(*ids).agg(F.count(f"_{r.columns[0]}").alias("n"))
    return n.where((F.col("n") < r.minimum) | (F.col("n") > r.maximum))


def reflected(data, r: Relation) -> DataFrame:
    """Parents of a declared relation with too few or too many children (``n``); one to one allows one."""
    low, high = r.children
    keys = list(r.parent_columns or data.registry.entities[r.parent].identity)
    return cardinality(data.frame(r.parent), data.frame(r.child), keys, list(r.columns), low, 1 if r.one2one else high)


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_edges(edges: DataFrame) -> DataFrame:
    """Edges that are alike in everything."""
    return duplicates(edges, edges.columns)


def edges_differing_by_order(edges: DataFrame, order: str = "ord") -> DataFrame:
    """Edges that are alike but for their order."""
    rest = [c for c in edges.columns if c != order]
    return edges.groupBy(*rest).agg(F.count_distinct(order).alias("n")).where("n > 1")


def unique_identity(df: DataFrame, identity: list[str]) -> DataFrame:
    """Identities that several rows share."""
    return duplicates(df, identity)


def constrained(df: DataFrame, key: list[str], shared: str) -> DataFrame:
    """Groups that don't agree on exactly one value of ``shared``."""
    return df.groupBy(*key).agg(F.count_distinct(shared).alias("n")).where("n <> 1")


def without_file(objects: DataFrame, files: DataFrame, created: str = "_dbcreated") -> DataFrame:
    """Objects created at a time at which no file was."""
    return objects.join(files.select(created).distinct(), created, "left_anti")


def absent_files(wanted: DataFrame, stored: DataFrame, key: str = "fname") -> DataFrame:
    """Requested files that aren't stored."""
    return wanted.join(stored.select(key).distinct(), key, "left_anti")


def _line(found: DataFrame, check: str, name: str) -> DataFrame:
    return found.agg(F.count("*").alias("offending")).select(F.lit(check).alias("check"), F.lit(name).alias("name"), "offending")


def report(data, wanted: DataFrame | None = None, stored: DataFrame | None = None) -> DataFrame:
    """One row per check of every declared entity and relation: what was checked and how many rows offend.

    With frames of ``wanted`` and ``stored`` files (fname) also those that are absent,
    and with stamps of creation in the stored files the objects that no file made.
    """
    parts = []
    for e in data.registry.entities.values():
        if not e.template:
            parts.append(_line(unique_identity(data.frame(e.name), list(e.identity)), "identity", e.name))
            if stored is not None and "_dbcreated" in stored.columns and "_dbcreated" in data.frame(e.name).columns:
                parts.append(_line(without_file(data.frame(e.name), stored), "without file", e.name))
    for r in data.registry.relations:
        name = f"{r.child} -> {r.parent}" + f" ({r.name})" * bool(r.name)
        if r.edges is not None:
            edges = r.edges(data)
            parts.append(_line(duplicate_edges(edges), "duplicate edges", name))
            if r.ordered and r.ordered in edges.columns:
                parts.append(_line(edges_differing_by_order(edges, r.ordered), "edges by order", name))
        elif r.columns and data.registry.entities[r.child].identity:
            parts.append(_line(relation(data, r), "relation", name))
            if (r.one2one or r.children != (0, None)) and not data.registry.entities[r.parent].template:
                parts.append(_line(reflected(data, r), "reflected", name))
            if r.ordered:
                parts.append(_line(duplicates(data.frame(r.child), [*r.columns, r.ordered]), "order", name))
    if wanted is not None and stored is not None:
        parts.append(_line(absent_files(wanted, stored), "absent files", "all"))
    return reduce(DataFrame.unionByName, parts)
