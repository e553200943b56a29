"""Join paths between entities, inferred from the declared relations."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from orrery.errors import AmbiguousPathError, CardinalityError, DisjointPathError
from orrery.plans.schema import Registry, Relation


@dataclass(frozen=True)
class Hop:
    """One relation in one direction: ``up`` from child to parent."""

    relation: Relation
    up: bool
    source: str
    target: str

    @property
    def singular(self) -> bool:
        return self.relation.maximum == 1 if self.up else self.relation.one2one

    @property
    def weight(self) -> float:
        if self.singular:
            return 0.0
        if self.up:
            return float(self.relation.maximum)
        return float(self.relation.children[1] or 1000)

    @property
    def optional(self) -> bool:
        return self.relation.optional if self.up else self.relation.children[0] == 0


def _kinds(registry: Registry, name: str) -> set[str]:
    """An entity with all templates above it."""
    out, at = set(), name
    while at:
        out.add(at)
        at = registry.entities[at].is_a
    return out


def _steps(registry: Registry, at: str, up: bool) -> list[Hop]:
    """Hops from an entity; to a template also as hops to each entity that extends it."""
    kinds = _kinds(registry, at)
    out = []
    for r in registry.relations:
        if r.name is None:
            if up and r.child in kinds:
                out += [Hop(r, True, at, e) for e in dict.fromkeys([r.parent, *registry.subclasses(r.parent)])]
            if not up and r.parent in kinds:
                out += [Hop(r, False, at, e) for e in dict.fromkeys([r.child, *registry.subclasses(r.child)])]
    return out


def _best(registry: Registry, start: str, goals: set[str], up: bool, allow) -> tuple[tuple[float, int], list[list[Hop]]] | None:
    """All cheapest paths in one direction by (weight, hops)."""
    heap: list = [((0.0, 0), 0, start, ())]
    tie, best, found, seen = 0, None, [], {}
    while heap:
        cost, _, at, path = heapq.heappop(heap)
        if best is not None and cost > best:
            break
        if path and at in goals:
            best = cost
            found.append(list(path))
            continue
        if seen.get(at, cost) < cost:
            continue
        seen[at] = cost
        for hop in _steps(registry, at, up):
            if allow(hop) and all(h.source != hop.target for h in path):
                tie += 1
                heapq.heappush(heap, ((cost[0] + hop.weight, cost[1] + 1), tie, hop.target, (*path, hop)))
    return (best, found) if best is not None else None


def find_paths(registry: Registry, start: str, goal: str, singular: bool = False) -> list[list[Hop]]:
    """Paths from ``start`` to ``goal``; several only where a template forks into its concrete entities.

    Singular paths come first (those without optional relations before others),
    then paths of any number; one direction at a time, upwards first.  Costs are
    (weight, hops); an equal cost through different entities is ambiguous.
    """
    goals = {goal, *registry.subclasses(goal)}
    searches = [lambda h: h.singular and not h.optional, lambda h: h.singular]
    if not singular:
        searches += [lambda h: not h.optional, lambda h: True]
    for allow in searches:
        options = [b for up in (True, False) if (b := _best(registry, start, goals, up, allow))]
        if options:
            cost = min(c for c, _ in options)
            paths = [p for c, found in options if c == cost for p in found]
            paths = [p for p in paths if p[-1].target == goal] or paths
            ends = [p[-1].target for p in paths]
            if len(paths) > 1 and (len(set(ends)) < len(ends) or not registry.entities[goal].template):
                raise AmbiguousPathError(f"{start} reaches {goal} by several paths: {'; '.join(' -> '.join(h.target for h in p) for p in paths)}")
            return paths
    if singular and find_paths(registry, start, goal):
        raise CardinalityError(f"{start} has several {registry.entities[goal].many}")
    raise DisjointPathError(f"no path leads from {start} to {goal}")
