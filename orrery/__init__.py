"""orrery: lazy object-graph queries and data pipelines on PySpark."""
