"""Resumable ingestion: files in batches, upserted into stored entities and edges, with a manifest on disk.

A store is a folder.  Every commit writes the changed tables to new folders and
then appends its manifest rows (reader, file, part, interval, and where each table
lies), in one write: what isn't in the manifest hasn't happened.  A store that is
opened again goes on from there.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.errors import SchemaError
from orrery.operators.upsert import covered, restore, upsert
from orrery.sources.dataset import normalise_missing
from orrery.sources.files import batches, same_names
from orrery.storage import discard, new_path, stored

MANIFEST = "reader string, fname string, part string, start long, end long, rows long, rejected long, seconds double, finished long, commit long, tables map<string,string>"
#: The end of a file that is read as a whole.
WHOLE = 2**63 - 1
#: Files or batches of one commit; the names of no more than these are on the driver at a time.
AT_ONCE = 10_000
#: In the manifest, the table of collisions of an entity.
COLLISIONS = "collisions of "


@dataclass(frozen=True)
class Reader:
    """How files become rows of an entity, or of several entities and edges.

    ``read(spark, paths)`` gives a frame, or frames by label; ``identity`` names the
    identity columns, by label if there are several.  With ``size`` and ``length``
    (frame of files to frame of fname and n, their rows) files are taken in intervals
    of rows for each of ``parts``, and ``read`` gets them as a frame of path, fname,
    start, end and part instead.  ``after`` names readers that come first.
    """

    entity: str
    read: Callable[[SparkSession, list[str] | DataFrame], DataFrame | dict[str, DataFrame]]
    identity: tuple[str, ...] | dict[str, tuple[str, ...]]
    match: str = ".*"
    after: tuple[str, ...] = ()
    size: int | None = None
    length: Callable[[DataFrame], DataFrame] | None = None
    parts: tuple[str | None, ...] = (None,)


def in_order(readers: list[Reader]) -> list[Reader]:
    """Readers after those they depend on."""
    done: list[Reader] = []
    left = list(readers)
    while left:
        ready = [r for r in left if not set(r.after) & {x.entity for x in left if x is not r}]
        if not ready:
            raise ValueError("the readers depend on each other")
        done += ready
        left = [r for r in left if r not in ready]
    return done


@dataclass
class Store:
    """Entities and edges below a folder, and the manifest of what has been read."""

    spark: SparkSession
    root: str | None = None
    tables: dict[str, str] = field(default_factory=dict)
    commit: int = 0

    def __post_init__(self) -> None:
        self.root = (self.root or new_path(self.spark, "store")).rstrip("/")
        last = self.manifest.agg(F.max("commit").alias("n"), F.max_by("tables", "commit").alias("tables")).first()
        if last["n"] is not None:
            self.tables, self.commit = dict(last["tables"]), last["n"]

    @property
    def manifest(self) -> DataFrame:
        """What has been read: reader, fname, part, start and end (inclusive), and the commit."""
        path = f"{self.root}/manifest"
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(path)

    def frame(self, label: str) -> DataFrame | None:
        """The rows of an entity or of edges."""
        return self.spark.read.parquet(self.tables[label]) if label in self.tables else None

    @property
    def frames(self) -> dict[str, DataFrame]:
        return {k: self.frame(k) for k in self.tables if not k.startswith(COLLISIONS)}

    @property
    def collisions(self) -> dict[str, DataFrame]:
        return {k.removeprefix(COLLISIONS): self.frame(k) for k in self.tables if k.startswith(COLLISIONS)}

    def complete(self, match: str = ".*", reader: str | None = None) -> DataFrame:
        """Names of files that have been read (by a reader)."""
        done = self.manifest.where(F.col("fname").rlike(f"^(?:{match})$"))
        return (done if reader is None else done.where(F.col("reader") == reader)).select("fname").distinct()

    def todo(self, files: DataFrame, reader: Reader, skip_complete: bool = True) -> DataFrame:
        """Intervals of the matching files that the reader hasn't read: path, fname, start, end, part."""
        mine = files.where(F.col("fname").rlike(f"^(?:{reader.match})$")).select("path", "fname")
        if reader.size is None:
            wanted = mine.select("fname", F.lit(0).cast("long").alias("start"), F.lit(WHOLE).alias("end"), F.lit(None).cast("string").alias("part"))
        else:
            lengths = reader.length(mine).select("fname", F.col("n").cast("long").alias("n"))
            wanted = batches(lengths, "n", reader.size, list(reader.parts)).select("fname", F.col("start").cast("long"), F.col("end").cast("long"), F.col("part").cast("string"))
        if skip_complete:
            wanted = covered(self.manifest.where(F.col("reader") == reader.entity), wanted, ["fname", "part"])
        return wanted.join(mine, "fname").select("path", "fname", "start", "end", "part")

    def write(self, files: DataFrame, readers: list[Reader], policy: str = "ignore", skip_complete: bool = True, dryrun: bool = False, test_one: bool = False, halt_on_error: bool = True, at_once: int = AT_ONCE) -> DataFrame:
        """Read what each reader hasn't read yet and merge it; gives a row per reader: what was done and how long it took.

        Each ``at_once`` files or batches are a commit.  The same name in two places is an error.
        """
        if same_names(files).limit(1).count():
            raise SchemaError("several files have the same name")
        stats = []
        for reader in in_order(readers):
            began, n_files, n_rows, n_rejected, error = time.time(), 0, 0, 0, None
            todo = self.todo(files, reader, skip_complete)
            if dryrun:
                n_files = todo.select("fname").distinct().count()
                todo = todo.limit(0)
            todo = stored(todo.orderBy("fname", "part", "start").limit(1) if test_one else todo, "todo")
            for group in self._groups(todo, at_once):
                try:
                    rows, rejected = self._commit(reader, group, policy)
                except Exception as e:
                    if halt_on_error:
                        raise
                    error = str(e)[:300]
                    continue
                n_files, n_rows, n_rejected = n_files + len({r["fname"] for r in group}), n_rows + rows, n_rejected + rejected
            discard(todo)
            stats.append((reader.entity, n_files, n_rows, n_rejected, time.time() - began, error))
        return self.spark.createDataFrame(stats, "entity string, files int, rows long, rejected long, elapsed_time double, error string")

    def write_directory(self, root: str, readers: list[Reader], match: str = ".*", antimatch: str | None = None, **how) -> DataFrame:
        """Find the files below a folder and write them."""
        from orrery.sources.files import discover

        return self.write(discover(self.spark, root, match, antimatch), readers, **how)

    @staticmethod
    def _groups(todo: DataFrame, at_once: int) -> Iterator[list]:
        rows = todo.orderBy("fname", "part", "start").toLocalIterator()
        while group := list(islice(rows, at_once)):
            yield group

    def _commit(self, reader: Reader, group: list, policy: str) -> tuple[int, int]:
        began = time.time()
        steps = self.spark.createDataFrame([tuple(r) for r in group], "path string, fname string, start long, end long, part string")
        found = reader.read(self.spark, sorted({r["path"] for r in group}) if reader.size is None else steps)
        found = found if isinstance(found, dict) else {reader.entity: found}
        tables, n_rows, n_rejected = dict(self.tables), 0, 0
        for label, rows in found.items():
            identity = list(reader.identity[label] if isinstance(reader.identity, dict) else reader.identity)
            rows = stored(normalise_missing(rows), "rows")  # read once, however often it is looked at
            n_rows += rows.count()
            old = self.frame(label)
            edges = {"src", "dst"} <= set(identity)
            merged, rejected = upsert(rows.limit(0) if old is None else old, rows, identity, policy, missing="drop" if edges else "raise")
            tables[label] = self._put(merged, label)
            if policy == "track":
                name = COLLISIONS + label
                had = self.frame(name)
                path = self._put(rejected, "collisions")
                n_rejected += self.spark.read.parquet(path).count()
                tables[name] = path if had is None else self._put(had.unionByName(self.spark.read.parquet(path)), "collisions")
            discard(rows)
        extra = {"rows": n_rows, "rejected": n_rejected, "seconds": time.time() - began, "finished": int(time.time() * 1000)}
        self._append(steps.select(F.lit(reader.entity).alias("reader"), "fname", "part", "start", "end", *[F.lit(v).alias(k) for k, v in extra.items()]), tables)
        return n_rows, n_rejected

    def _put(self, df: DataFrame, label: str) -> str:
        path = f"{self.root}/tables/{label.lower()}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _append(self, rows: DataFrame, tables: dict[str, str]) -> None:
        where = F.create_map(*[F.lit(x) for kv in tables.items() for x in kv]).cast("map<string,string>")
        full = rows.withColumns({"commit": F.lit(self.commit + 1).cast("long"), "tables": where})
        full.select([F.col(c.split()[0]).cast(c.split()[1]) for c in MANIFEST.split(", ")]).write.mode("append").parquet(f"{self.root}/manifest")
        self.tables, self.commit = tables, self.commit + 1

    def restore_state(self, at: int) -> None:
        """Drop everything that was created after a time stamp."""
        tables = {k: v if k.startswith(COLLISIONS) else self._put(restore(self.frame(k), at), k) for k, v in self.tables.items()}
        none = [F.lit(None).alias(c) for c in ("part", "rows", "rejected", "seconds")]
        row = self.spark.range(1).select(F.lit("").alias("reader"), F.lit("").alias("fname"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), *none, F.lit(int(time.time() * 1000)).alias("finished"))
        self._append(row, tables)


def constraints(data) -> DataFrame:
    """What a store must hold to: a row per entity and identity, and per relation and its bounds."""
    rows = [("identity", e.name, ",".join(e.identity), 1, 1) for e in data.registry.entities.values() if e.identity and not e.template]
    rows += [("relation", f"{r.child} -> {r.parent}", ",".join(r.columns), r.minimum, r.maximum) for r in data.registry.relations]
    return data.spark.createDataFrame(rows, "kind string, name string, columns string, minimum int, maximum int")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Frames of one label from several readers."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
