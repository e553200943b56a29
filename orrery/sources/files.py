"""Files: discovery, manifests, text tables, products and decoders."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def discover(spark: SparkSession, root: str, match: str = ".*", antimatch: str | None = None, done: DataFrame | None = None) -> DataFrame:
    """Files below a folder (any store that Spark reads): path, fname, length, modified.

    ``match`` and ``antimatch`` are regular expressions for whole file names;
    files of ``done`` (column fname) are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).drop("content")
    files = files.select("path", F.element_at(F.split("path", "/"), -1).alias("fname"), "length", F.col("modificationTime").alias("modified"))
    files = files.where(F.col("fname").rlike(f"^(?:{match})$"))
    if antimatch:
        files = files.where(~F.col("fname").rlike(f"^(?:{antimatch})$"))
    return files if done is None else files.join(done.select("fname").distinct(), "fname", "left_anti")


def same_names(files: DataFrame) -> DataFrame:
    """File names that occur in several places."""
    return files.groupBy("fname").agg(F.count("*").alias("n")).where("n > 1")


def batches(files: DataFrame, rows: str, size: int, parts: list[str | None] = [None]) -> DataFrame:  # noqa: B006
    """Row ranges of files to be read in steps: fname, start, end (inclusive), part."""
    steps = F.explode(F.sequence(F.lit(0), F.greatest(F.col(rows) - 1, F.lit(0)), F.lit(size)))
    out = files.select("fname", F.col(rows).alias("_n"), steps.alias("start"))
    out = out.select("fname", "start", F.least(F.col("start") + size, F.col("_n")).alias("_stop")).select("fname", "start", (F.col("_stop") - 1).alias("end"))
    return out.withColumn("part", F.explode(F.array(*[F.lit(p) for p in parts])))


def file_parts(files: DataFrame, names: list[str]) -> DataFrame:
    """One row per part (by number and name) of every file."""
    return files.crossJoin(F.broadcast(files.sparkSession.createDataFrame(list(enumerate(names)), "extn int, part string")))


def wrong_parts(manifest: DataFrame, expected: int) -> DataFrame:
    """Files whose number of parts (``n``) isn't the expected one."""
    return manifest.groupBy("fname").agg(F.count("*").alias("n")).where(F.col("n") != expected)


def headers(located: DataFrame, read: Callable[[str, int], dict], key: str | None = None, path: str = "path", extn: str = "extn") -> DataFrame:
    """Headers of the parts behind locators (path, extn): a map of all their keywords as text, or the value of one.

    ``read(path, extn)`` gives a part's header; it is called once for each part in a batch.
    """
    places = located.select(path, extn).distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [{str(k): None if v is None else str(v) for k, v in read(p, int(e)).items()} for p, e in zip(frame[path], frame[extn], strict=True)]
            yield frame.assign(header=[x if key is None else x.get(key) for x in found])

    kinds = dict(located.dtypes)
    return places.mapInPandas(run, f"`{path}` {kinds[path]}, `{extn}` {kinds[extn]}, header {'map<string,string>' if key is None else 'string'}")


def locators(rows: DataFrame, path: str, extn: int, index: Column, column: str) -> DataFrame:
    """Rows with a locator (path, extn, index, column) of a product each, to be read late."""
    return rows.withColumn("locator", F.struct(F.lit(path).alias("path"), F.lit(extn).alias("extn"), index.alias("index"), F.lit(column).alias("column")))


def write_masked(df: DataFrame, path: str, fills: dict[str, object]) -> None:
    """Write a table whose fill values stand for masked entries: these become null, NaN stays NaN, and the fill values are kept beside the columns."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        out.append(F.when(c != F.lit(fills[f.name]), c).alias(f.name, metadata={"fill": fills[f.name]}) if f.name in fills else c)
    df.select(*out).write.parquet(path)


def read_masked(spark: SparkSession, path: str, filled: bool = False) -> DataFrame:
    """Read it back: masked entries are null, or have their fill values again with ``filled``."""
    df = spark.read.parquet(path)
    return df.select(*[F.coalesce(F.col(f"`{f.name}`"), F.lit(f.metadata["fill"]).cast(f.dataType)).alias(f.name) if filled and "fill" in f.metadata else F.col(f"`{f.name}`") for f in df.schema.fields])


def text_table(spark: SparkSession, path: str, sep: str = " ", **options) -> DataFrame:
    """A table in text with a header."""
    return spark.read.options(header=True, inferSchema=True, sep=sep, ignoreLeadingWhiteSpace=True, **options).csv(path)


def products(located: DataFrame, read: Callable[[str, int, list[int]], list], path: str = "path", extn: str = "extn", index: str = "index") -> DataFrame:
    """Arrays behind locators, read late: rows of one (path, extn) are read together, at most once a batch.

    ``read(path, extn, rows)`` gives the arrays of the rows.  Rows are laid out by
    file without collecting a file in one task.
    """
    columns = located.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.reset_index(drop=True)
            value: list = [None] * len(frame)
            for (p, e), part in frame.groupby([path, extn], dropna=True):
                for i, x in zip(part.index, read(p, int(e), part[index].astype(int).tolist()), strict=True):
                    value[i] = [float(v) for v in x]
            yield frame.assign(value=value)[[*columns, "value"]]

    schema = ", ".join(f"`{n}` {t}" for n, t in located.dtypes) + ", value array<double>"
    return located.repartitionByRange(path, extn, index).mapInPandas(run, schema)


def parquet_products(column: str, key: str) -> Callable[[str, int, list[int]], list]:
    """A product reader for Parquet tables: rows by key."""

    def read(path: str, extn: int, rows: list[int]) -> list:
        import pyarrow.dataset as ds

        table = ds.dataset(path).to_table(columns=[key, column], filter=ds.field(key).isin(rows))
        found = dict(zip(table[key].to_pylist(), table[column].to_pylist(), strict=True))
        return [found.get(r) or [] for r in rows]

    return read


def decode(code: Column, tables: list[dict[str, object]]) -> list[Column]:
    """One value for each letter of a code, by its own table."""
    return [F.element_at(F.create_map(*[F.lit(x) for kv in t.items() for x in kv]), F.substring(code, i + 1, 1)) for i, t in enumerate(tables)]


def grid(first: Column, step: Column, n: Column) -> Column:
    """first, first + step, ... (n values)."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: first + i * step)


def highest(kinds: list[str], column: Column) -> Column:
    """The highest-ranking of a list of kinds, given in ascending order."""
    rank = F.array(*[F.lit(k) for k in kinds])
    return F.element_at(rank, F.array_max(F.transform(column, lambda k: F.array_position(rank, k).cast("int"))))


def file_kind(names: Column, patterns: dict[str, str]) -> Column:
    """The first kind whose pattern matches a whole file name."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(patterns.items()):
        re.compile(pattern)
        out = F.when(names.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out
