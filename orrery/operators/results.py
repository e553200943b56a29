"""What running a query gives back."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page(df: DataFrame, limit: int | None, skip: int = 0, distinct: bool = False) -> DataFrame:
    """DISTINCT, then OFFSET and LIMIT, in a fixed order of the rows where one exists."""
    df = df.distinct() if distinct else df
    if limit is None and not skip:
        return df
    sortable = [c for c, t in df.dtypes if not t.startswith("map")]
    df = df.orderBy(*sortable) if sortable else df
    df = df.offset(skip) if skip else df
    return df if limit is None else df.limit(limit)


def collect(query, limit: int | None = 1000, skip: int = 0, distinct: bool = False):
    """pandas rows of a query: one column gives a Series, one row of one column a value, ``limit=1`` a row.

    One more row than ``limit`` is fetched, to tell whether there are more.
    """
    from orrery.operators.query import AttributeQuery

    out = page(query.to_df(), None if limit is None else limit + 1, skip, distinct).toPandas()
    if limit is not None and len(out) > limit:
        if limit != 1:
            warnings.warn(f"only the first {limit} rows are shown: pass limit=None for all", stacklevel=3)
        out = out.head(limit)
    scalar = isinstance(query, AttributeQuery) and query.node is None
    if out.shape[1] == 1:
        column = out.iloc[:, 0]
        return column.iloc[0] if (scalar or limit == 1) and len(column) else column
    return out.iloc[0] if limit == 1 and len(out) else out


def rectangular(column: pd.Series) -> np.ma.MaskedArray:
    """Lists of different lengths as a masked array with as many columns as the longest has."""
    lists = [np.asarray([] if x is None else x) for x in column]
    width = max((len(x) for x in lists), default=0)
    kind = np.result_type(*[x.dtype for x in lists if len(x)]) if any(len(x) for x in lists) else float
    out = np.ma.masked_all((len(lists), width), dtype=kind)
    for i, x in enumerate(lists):
        if len(x):
            out[i, : len(x)] = x
    return out


def masked(df: DataFrame, column: str, drop) -> DataFrame:
    """The column with nulls where ``drop`` holds."""
    return df.withColumn(column, F.when(~F.coalesce(drop, F.lit(False)), F.col(column)))


def filtered(df: DataFrame, column: str, keep) -> DataFrame:
    """The column with nulls where ``keep`` doesn't hold."""
    return df.withColumn(column, F.when(keep, F.col(column)))


def apply(df: DataFrame, function, schema: str) -> DataFrame:
    """A function of pandas frames over the rows, batch by batch."""
    return df.mapInPandas(lambda batches: (function(b) for b in batches), schema)
