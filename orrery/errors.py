"""What can be wrong with a query, found before any Spark job runs."""


class QueryError(Exception):
    """Any of the errors below."""


class AmbiguousPathError(QueryError):
    """Several equally good paths or owners."""


class CardinalityError(QueryError):
    """A plural relation by its singular name, or the other way round."""


class AttributeNameError(QueryError, AttributeError):
    """No attribute, object or relation has this name."""


class DisjointPathError(QueryError):
    """Operands that share no ancestor, or an aggregate over something that isn't below its ``wrt``."""


class SchemaError(QueryError):
    """A declaration that contradicts itself."""


class PropertyOverlapError(QueryError):
    """A column that is both identity and property."""


class NullPropertyError(QueryError):
    """An identity with a missing value."""


class CollisionError(QueryError):
    """A policy that isn't known."""
