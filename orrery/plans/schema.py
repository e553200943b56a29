"""Entities, relations and the registry that resolves names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from orrery.errors import AttributeNameError, SchemaError
from orrery.naming import plural, snake, suggest

RESERVED = {"keys", "values", "dict", "items"}


@dataclass(frozen=True)
class Relation:
    """``child`` holds ``columns`` that name one ``parent`` by its identity (or ``parent_columns``).

    With ``edges`` the two are joined through an edge frame (src, dst: parent's and
    child's identity) instead.  ``name`` makes it a relative relation, reached
    by that name only.  ``minimum`` and ``maximum`` bound the parents a child has,
    ``one2one`` and ``children`` the children a parent has.
    """

    parent: str
    child: str
    columns: tuple[str, ...] = ()
    name: str | None = None
    edges: Callable | None = None
    minimum: int = 1
    maximum: int = 1
    one2one: bool = False
    children: tuple[int, int | None] = (0, None)
    ordered: str | None = None
    parent_columns: tuple[str, ...] = ()

    @property
    def optional(self) -> bool:
        return self.minimum == 0


@dataclass(frozen=True)
class Entity:
    """A kind of object: its table, identity, attributes and products (large arrays)."""

    name: str
    table: str = ""
    identity: tuple[str, ...] = ()
    attributes: tuple[str, ...] = ()
    products: tuple[str, ...] = ()
    is_a: str | None = None
    template: bool = False
    rename: tuple[tuple[str, str], ...] = ()
    plural: str = ""
    doc: str = ""
    default: str | None = None

    @property
    def single(self) -> str:
        return snake(self.name)

    @property
    def many(self) -> str:
        return self.plural or plural(self.single)


def measures(*names: str, prefix: str = "", parts: tuple[str, ...] = ("value", "error")) -> tuple[str, ...]:
    """Attribute names of flattened measurements: {prefix}{name} for the value, {prefix}{name}_{part} for others."""
    return tuple(f"{prefix}{n}" if p == "value" else f"{prefix}{n}_{p}" for n in names for p in parts)


@dataclass
class Registry:
    """All entities and relations, checked against each other."""

    entities: dict[str, Entity] = field(default_factory=dict)
    relations: list[Relation] = field(default_factory=list)

    def add(self, *entities: Entity) -> Registry:
        for e in entities:
            if not e.name[:1].isupper() or e.name.startswith("_"):
                raise SchemaError(f"{e.name}: entity names are CamelCase")
            if e.single in RESERVED or e.many in RESERVED or e.single == e.many:
                raise SchemaError(f"{e.name}: its names are reserved or don't differ in number")
            if not e.template and not e.identity:
                raise SchemaError(f"{e.name}: no identity")
            if missing := set(e.identity) - set(e.attributes):
                raise SchemaError(f"{e.name}: identity {sorted(missing)} isn't among its attributes")
            if clash := set(e.attributes) & set(e.products):
                raise SchemaError(f"{e.name}: {sorted(clash)} are attributes and products")
            if e.is_a and not self.entities.get(e.is_a, e).template:
                raise SchemaError(f"{e.name}: only templates can be extended")
            if e.is_a and e.is_a not in self.entities:
                raise SchemaError(f"{e.name}: {e.is_a} isn't declared")
            taken = {n for x in self.entities.values() for n in (x.single, x.many)}
            if {e.single, e.many} & taken:
                raise SchemaError(f"{e.name}: its names are taken")
            self.entities[e.name] = e
        return self

    def relate(self, *relations: Relation) -> Registry:
        for r in relations:
            for end in (r.parent, r.child):
                if end not in self.entities:
                    raise SchemaError(f"{end} isn't declared")
            if r.minimum > r.maximum or r.maximum < 1:
                raise SchemaError(f"{r.child} -> {r.parent}: bad bounds")
            if not r.columns and r.edges is None:
                raise SchemaError(f"{r.child} -> {r.parent}: neither columns nor edges")
            self.relations.append(r)
        return self

    def subclasses(self, name: str) -> list[str]:
        """Concrete entities that are ``name`` or extend it."""
        out = []
        for e in self.entities.values():
            at: Entity | None = e
            while at is not None and at.name != name:
                at = self.entities.get(at.is_a) if at.is_a else None
            if at is not None and not e.template:
                out.append(e.name)
        return out

    def entity_named(self, name: str) -> tuple[Entity, bool] | None:
        """The entity with this singular or plural name, and whether it was plural."""
        for e in self.entities.values():
            if name == e.many:
                return e, True
            if name == e.single:
                return e, False
        return None

    def owners(self, attribute: str) -> list[Entity]:
        """Entities that own an attribute; those covered by a template that owns it as well are left out."""
        own = [e for e in self.entities.values() if attribute in e.attributes or attribute in e.products]
        names = {e.name for e in own}
        return [e for e in own if not (e.is_a and e.is_a in names)]

    def attribute_named(self, name: str) -> tuple[str, bool] | None:
        """The attribute with this name, or with this as its plural."""
        known = {a for e in self.entities.values() for a in (*e.attributes, *e.products)}
        if name in known:
            return name, False
        return next(((a, True) for a in sorted(known) if plural(a) == name), None)

    def relatives(self, name: str) -> list[Relation]:
        return [r for r in self.relations if r.name == name]

    def names(self) -> list[str]:
        """Everything a query can say."""
        out = {n for e in self.entities.values() for n in (e.single, e.many, *e.attributes, *e.products)}
        return sorted(out | {r.name for r in self.relations if r.name})

    def unknown(self, name: str) -> AttributeNameError:
        return AttributeNameError(f"{name} isn't known; did you mean {', '.join(suggest(name, self.names()))}?")

    def compatible(self, older: Registry) -> list[str]:
        """Why data stored under ``older`` can't be read under this; empty if it can."""
        out = []
        for name, e in older.entities.items():
            new = self.entities.get(name)
            if new is None:
                out.append(f"{name} is gone")
                continue
            if new.identity != e.identity:
                out.append(f"{name}: identity changed")
            if lost := set(e.attributes) - set(new.attributes):
                out.append(f"{name}: lost {sorted(lost)}")
        for r in self.relations:
            same = [o for o in older.relations if (o.parent, o.child, o.name) == (r.parent, r.child, r.name)]
            if not same and r.child in older.entities and not r.optional:
                out.append(f"{r.child} -> {r.parent}: a new relation must be optional")
        return out

    def frame(self, spark) -> DataFrame:
        """The class graph as a small table: one row per entity or relation."""
        rows = [("entity", e.name, e.is_a, None, e.template) for e in self.entities.values()]
        rows += [("relation", r.child, r.parent, r.name, r.optional) for r in self.relations]
        return spark.createDataFrame(rows, "kind string, name string, target string, relative string, flag boolean")
