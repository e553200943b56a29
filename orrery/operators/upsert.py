"""Idempotent writes: merging rows and edges into stored frames.

A write is a full-outer join of the stored rows and the new ones on identity
columns, compared null-safely.  Policies for values on both sides: ``ignore``
keeps the stored one, ``overwrite`` takes the new one, ``track`` keeps the stored
one and reports the rejected values.  Missing values never replace known ones.

Several source rows of one identity count as written one after the other, in a
stated order: the first known value of a property stays (``ignore``, ``track``), or
the last one does (``overwrite``), so a row's values stay together unless one is
missing.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.errors import CollisionError, NullPropertyError, PropertyOverlapError

POLICIES = ("ignore", "overwrite", "track")
CREATED, UPDATED = "_dbcreated", "_dbupdated"


def different(a: Column, b: Column) -> Column:
    """Null-safe inequality."""
    return ~a.eqNullSafe(b)


def _missing(df: DataFrame, identity: list[str]) -> Column:
    """Whether a value of the identity is null or NaN."""
    kinds = dict(df.dtypes)
    return reduce(lambda a, b: a | b, [F.isnull(c) | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False)) for c in identity])


def check_keys(df: DataFrame, identity: list[str], properties: list[str] | None = None) -> None:
    """Identity and properties may not overlap; an identity value may be neither missing nor NaN."""
    if overlap := set(identity) & set(properties or []):
        raise PropertyOverlapError(f"{sorted(overlap)} are identity and properties")
    if df.where(_missing(df, identity)).limit(1).count():
        raise NullPropertyError(f"an identity of {identity} has a missing value")


def _place(df: DataFrame, columns: list[str]) -> Column:
    """The columns as one value that can be ordered (maps by their text)."""
    kinds = dict(df.dtypes)
    return F.struct(*[F.to_json(c).alias(c) if "map<" in kinds[c] else F.col(c) for c in columns])


def folded(source: DataFrame, identity: list[str], policy: str, order: list[str] | None = None) -> DataFrame:
    """One row an identity: each property's first known value in ``order`` (the last one under ``overwrite``)."""
    props = [c for c in source.columns if c not in identity]
    if not props:
        return source.select(*identity).distinct()
    place, pick = _place(source, [*(order or []), *[c for c in props if c not in (order or [])]]), F.max_by if policy == "overwrite" else F.min_by
    return source.groupBy(*identity).agg(*[pick(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(c) for c in props]).select(*source.columns)


def upsert(target: DataFrame, source: DataFrame, identity: list[str], policy: str = "ignore", now: int | None = None, stamps: bool = True, order: list[str] | None = None, missing: str = "raise") -> tuple[DataFrame, DataFrame]:
    """The merged rows, and the rejected values (identity, column, old, new, at) under ``track``.

    Source rows of one identity are written in the order of the columns ``order``,
    then of all properties, so that a write doesn't depend on the order of rows.  A
    source row whose identity has a missing value is an error, or left out with
    ``missing="drop"``.
    """
    if policy not in POLICIES:
        raise CollisionError(f"{policy} isn't one of {', '.join(POLICIES)}")
    if missing == "drop":
        source = source.where(~_missing(source, identity))
    else:
        check_keys(source, identity)
    now = int(time.time() * 1000) if now is None else now
    props = [c for c in dict.fromkeys([*target.columns, *source.columns]) if c not in (*identity, CREATED, UPDATED)]
    fresh = [c for c in props if c in source.columns]
    rows = source.select(*identity, *fresh)
    one = folded(rows, identity, policy, [c for c in order or [] if c in fresh])
    t = target.select(*[F.col(c).alias(f"t_{c}") for c in target.columns], F.lit(True).alias("t_here"))
    s = one.select(*[F.col(c).alias(f"s_{c}") for c in one.columns], F.lit(True).alias("s_here"))
    both = t.join(s, [t[f"t_{c}"].eqNullSafe(s[f"s_{c}"]) for c in identity], "full")

    def side(prefix: str, c: str, frame: DataFrame) -> Column:
        return F.col(f"{prefix}_{c}") if c in frame.columns else F.lit(None)

    def value(c: str) -> Column:
        old, new = side("t", c, target), side("s", c, one)
        return F.coalesce(new, old) if policy == "overwrite" else F.coalesce(old, new)

    out = [F.when(F.col("t_here"), F.col(f"t_{c}")).otherwise(F.col(f"s_{c}")).alias(c) for c in identity] + [value(c).alias(c) for c in props]
    if stamps:
        stamp = F.lit(now).cast("long")
        created = F.coalesce(side("t", CREATED, target).cast("long"), stamp) if CREATED in target.columns else stamp
        updated = F.when(F.col("s_here"), stamp).otherwise(side("t", UPDATED, target).cast("long"))
        out += [created.alias(CREATED), updated.alias(UPDATED)]
    return both.select(*out), _rejected(both, rows, identity, fresh, target, policy).withColumn("at", F.lit(now).cast("long"))


def _rejected(both: DataFrame, rows: DataFrame, identity: list[str], fresh: list[str], target: DataFrame, policy: str) -> DataFrame:
    """Every distinct source value that isn't the one that stays: the stored one, or of a new identity the first."""
    none = [F.lit(None).cast("string").alias(c) for c in ("column", "old", "new")]
    if policy != "track" or not fresh:
        return rows.limit(0).select(*identity, *none)
    stays = [F.when(F.col("t_here"), F.col(f"t_{c}") if c in target.columns else F.col(f"s_{c}")).otherwise(F.col(f"s_{c}")).alias(f"o_{c}") for c in fresh]
    old = both.where("s_here").select(*[F.col(f"s_{c}").alias(f"o_{c}") for c in identity], *stays)
    new = rows.distinct() if not any("map<" in kind for _, kind in rows.dtypes) else rows
    held = new.join(old, [new[c].eqNullSafe(old[f"o_{c}"]) for c in identity])
    clashes = [F.when(different(F.col(f"o_{c}"), F.col(c)), F.struct(F.lit(c).alias("column"), F.col(f"o_{c}").cast("string").alias("old"), F.col(c).cast("string").alias("new"))) for c in fresh]
    return held.select(*identity, F.explode(F.array_compact(F.array(*clashes))).alias("x")).select(*identity, "x.*").distinct()


def upsert_edges(target: DataFrame, source: DataFrame, identity: list[str] | None = None, policy: str = "ignore", now: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst and properties); those without one of their ends are left out."""
    return upsert(target, source, ["src", "dst", *(identity or [])], policy, now, missing="drop")


def ordered_edges(df: DataFrame, src: str, dsts: str, order: str = "ord") -> DataFrame:
    """Edges from an object to each of a list of others, with their place in the list; missing ones leave a gap."""
    return df.select(F.col(src).alias("src"), F.posexplode(dsts).alias(order, "dst")).where("dst is not null").select("src", "dst", order)


def attach(edges: DataFrame, objects: DataFrame, src: str, dst: str, properties: list[str] = (), mirrored: bool = False, policy: str = "ignore", now: int | None = None) -> DataFrame:
    """Edges with those of optional relations (or products) of ``objects`` added; ``mirrored`` ones lead back as well."""
    found = objects.select(F.col(src).alias("src"), F.col(dst).alias("dst"), *properties)
    if mirrored:
        found = found.unionByName(found.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *properties))
    return upsert_edges(edges, found, policy=policy, now=now)[0]


Parents = list[str] | tuple[str, ...] | dict[str, list[str]]


def relational_key(columns: list[str], parents: Parents = (), optional: list[str] = ()) -> Column:
    """Identity of an object that depends on others, as a struct: its own columns, its parents by kind, and its optional ones (null where absent).

    ``parents`` names columns, each a kind of its own, or gives the columns of each
    kind: within a kind the order doesn't count.
    """
    kinds = parents if isinstance(parents, dict) else {p: [p] for p in parents}
    held = [F.array_sort(F.array(*[F.col(c) for c in cs])).alias(f"parents_{k}") for k, cs in kinds.items()]
    return F.struct(*[F.col(c).alias(f"own_{c}") for c in columns], *held, *[F.col(o).alias(f"optional_{o}") for o in optional])


def merge_dependent(target: DataFrame, source: DataFrame, columns: list[str], parents: Parents = (), optional: list[str] = (), policy: str = "ignore", now: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Upsert of objects whose identity includes their relations; ``track`` isn't offered for them."""
    if policy == "track":
        raise NotImplementedError("collisions of dependent objects aren't tracked")
    key = relational_key(columns, parents, optional)
    have = target.drop("_key").withColumn("_key", key)
    merged, rejected = upsert(have, source.drop("_key").withColumn("_key", key), ["_key"], policy, now)
    return merged.drop("_key"), rejected


def merge_object(target: DataFrame, edges: DataFrame, source: DataFrame, columns: list[str], parents: Parents = (), optional: list[str] = (), strategy: str = "relations", policy: str = "ignore", now: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Objects and their edges from parents (src: the parent, dst: the object's own columns, kind) by one of two strategies.

    ``node``: the object is known by its own columns, and a new parent is one more
    edge.  ``relations``: its parents belong to its identity.
    """
    if strategy == "node":
        names = [c for cs in (parents.values() if isinstance(parents, dict) else [parents]) for c in cs]
        merged, _ = upsert(target, source.drop(*names, *optional), columns, policy, now)
    else:
        merged, _ = merge_dependent(target, source, columns, parents, optional, policy, now)
    kinds = (parents if isinstance(parents, dict) else {p: [p] for p in parents}) | {o: [o] for o in optional}
    own = F.struct(*columns)
    for kind, cs in kinds.items():
        for c in cs:
            found = source.select(F.col(c).cast("string").alias("src"), own.alias("dst"), F.lit(kind).alias("kind"))
            edges, _ = upsert_edges(edges, found, ["kind"], policy, now)
    return merged, edges


def set_version(df: DataFrame, parents: list[str], order: list[str], version: str = "version") -> DataFrame:
    """Existing versions stay; new rows count on from the highest of their parents, starting at 0."""
    group = Window.partitionBy(*parents)
    new = F.row_number().over(Window.partitionBy(*parents, F.col(version).isNull()).orderBy(*order))
    highest = F.coalesce(F.max(version).over(group), F.lit(-1))
    return df.withColumn(version, F.coalesce(F.col(version), (highest + new).cast(dict(df.dtypes)[version])))


def intervals(df: DataFrame, group: list[str], column: str) -> DataFrame:
    """Runs of consecutive numbers: group, start and end."""
    rows = df.select(*group, column).distinct()
    island = F.col(column) - F.row_number().over(Window.partitionBy(*group).orderBy(column))
    return rows.withColumn("_island", island).groupBy(*group, "_island").agg(F.min(column).alias("start"), F.max(column).alias("end")).drop("_island")


def covered(done: DataFrame, wanted: DataFrame, group: list[str]) -> DataFrame:
    """Wanted batches (group, start, end) that no completed interval covers."""
    d = done.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("start").alias("_start"), F.col("end").alias("_end"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group])
    return wanted.join(d, same & (F.col("_start") <= F.col("start")) & (F.col("_end") >= F.col("end")), "left_anti")


def restore(df: DataFrame, at: int) -> DataFrame:
    """Only what had been created by a time stamp."""
    return df.where(F.col(CREATED) <= at)


def unwind(df: DataFrame, *columns: str, index: str | None = None) -> DataFrame:
    """Lists side by side as rows, shorter ones padded with nulls; with ``index`` the position as well."""
    packed = df.withColumn("_z", F.arrays_zip(*columns)).drop(*columns)
    keep = [c for c in packed.columns if c != "_z"]
    rows = packed.select(*keep, F.posexplode("_z").alias(index or "_at", "_x"))
    return rows.select(*keep, *([index] if index else []), *[F.col(f"_x.{c}").alias(c) for c in columns])


def collect_rows(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Rows gathered as a sorted list for each group."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(column)).alias(column))


def group_map(df: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """A map from key (as text) to value for each group."""
    return df.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.col(key).cast("string"), F.col(value))))).alias("map"))


def union_lists(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """List columns of a group merged, sorted and without duplicates."""
    return df.groupBy(*by).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(column)))).alias(column))


def custom(df: DataFrame, function: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Any step of one's own."""
    return df.transform(function)


def violations(target: DataFrame, source: DataFrame, identity: list[str]) -> DataFrame:
    """Stored and proposed values of the columns in which rows of one identity differ."""
    shared = [c for c in source.columns if c in target.columns and c not in identity]
    s = source.select(*identity, *[F.col(c).alias(f"_{c}") for c in shared])
    diffs = F.array_compact(F.array(*[F.when(different(F.col(c), F.col(f"_{c}")), F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("stored"), F.col(f"_{c}").cast("string").alias("proposed"))) for c in shared]))
    return target.join(s, identity).select(*identity, F.explode(diffs).alias("d")).select(*identity, "d.*")
