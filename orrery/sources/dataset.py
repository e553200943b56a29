"""A dataset: the frames behind the declared entities."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.query import ObjectQuery, start
from orrery.plans.schema import Entity, Registry

MISSING_TEXT = "<MISSING>"


def normalise_missing(df: DataFrame) -> DataFrame:
    """NaN, infinities and the text ``<MISSING>`` become null."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
        elif kind == "string":
            c = F.when(c == MISSING_TEXT, None).otherwise(c)
        elif kind == "array<string>":
            c = F.transform(c, lambda x: F.when(x == MISSING_TEXT, None).otherwise(x))
        out.append(c.alias(name))
    return df.select(*out)


class Dataset:
    """Entry point of queries: ``data.customers``, ``data.c_name``, ``data.next_event``."""

    def __init__(self, spark: SparkSession, root: str, registry: Registry, frames: dict[str, Callable[[SparkSession, str], DataFrame]] | None = None):
        self.spark, self.root, self.registry, self._frames = spark, root.rstrip("/"), registry, frames or {}

    def table(self, entity: Entity) -> DataFrame:
        """All columns of a concrete entity's table, with the names its template uses beside its own."""
        if entity.name in self._frames:
            df = self._frames[entity.name](self.spark, self.root)
        else:
            df = self.spark.read.parquet(f"{self.root}/{entity.table or entity.many}.parquet")
        return df.withColumns({new: F.col(old) for old, new in entity.rename})

    def frame(self, name: str) -> DataFrame:
        """Rows of an entity; a template's are those of all entities that extend it."""
        entity = self.registry.entities[name]
        if not entity.template:
            return self.table(entity)
        parts = []
        for sub in self.registry.subclasses(name):
            own = self.registry.entities[sub]
            df = self.table(own)
            shared = [c for c in (*entity.attributes, *entity.products) if c in df.columns]
            parts.append(df.select(*shared, F.lit(sub).alias("_type"), *([] if entity.identity else [identity_of(own).cast("string").alias("_id")])))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def identity(self, name: str) -> Column:
        entity = self.registry.entities[name]
        return identity_of(entity) if entity.identity else F.struct("_type", "_id")

    def __getattr__(self, name: str) -> ObjectQuery:
        if name.startswith("_"):
            raise AttributeError(name)
        return start(self, name)

    __getitem__ = __getattr__

    def __dir__(self) -> list[str]:
        return [*super().__dir__(), *self.registry.names()]


def identity_of(entity: Entity) -> Column:
    """The identity as one column: the column itself, or a struct of several."""
    return F.col(entity.identity[0]) if len(entity.identity) == 1 else F.struct(*entity.identity)
