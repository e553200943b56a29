"""Mixing sources to target weights: capped water-filling, DataFrame functions only.

Sources share a total by weight; no source's target may exceed ``max_epochs``
times its size.  The filling is solved in closed form: with sources in ascending
order of cap over weight, a source is clamped to its cap exactly if its fair
share of what is left, after all sources before it were clamped, is above its
cap; the level of the rest follows from what remains.  That is the fixed point of
clamping and resharing again and again.

A source with e = target / size epochs takes every document floor(e) times, and a
seeded sample once more: documents in the order of a hash of seed and id, until
the fraction is used up.  The order is not sorted as a whole: sizes are summed by (source,
hash bucket), the bucket in which a source's fraction ends is found from those
sums, and only documents of that bucket are ordered.  A few documents that fit
close the gap that is left, and one that doesn't if the target is then nearer.  No document is taken more
often than ``max_epochs`` times.

Defined cases: null texts have size 0; the null source is a source (last in
order); a source whose documents are all empty takes nothing; rows of a source are
known by id and text, so rows that repeat both are one document to the sample:
they are taken equally often; an empty table gives no rows; other columns are ignored by ``mix_rows``,
kept by ``mix``, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm._joins import unused
from orrery.storage import stored

WEIGHTS = (1.0, 2.0, 3.0)
MAX_EPOCHS = 3
SEED = 17
BUCKETS = 4096
#: Documents of a size class that may close a source's gap.
CANDIDATES = 4
#: Rows of a table of sources that are broadcast; the others are joined even if a source is hot.
MOST_SOURCES = 5_000
#: Parts in which rows meet the rest of the sources.
SALT = 64


def n_words(text: Column) -> Column:
    """Number of runs of bytes other than white space (0x20, 0x09-0x0D); null has none."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return (F.length(bare) - F.length(F.replace(bare, F.lit("x"), F.lit("")))).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """source, source_size and target, from a frame of source and source_size (one row a source)."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    table = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int")))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after, whole = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    table = table.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    table = table.withColumn("total", F.sum("source_size").over(whole) * share)
    table = table.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("weights_left", F.sum("weight").over(after))
    table = table.withColumn("clamped", F.col("cap") * F.col("weights_left") <= F.col("weight") * F.col("left"))
    free = F.coalesce(F.sum(F.when(~F.col("clamped"), F.col("weight"))).over(whole), F.lit(0.0))
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("clamped"), F.col("cap"))).over(whole), F.lit(0.0))
    level = F.when(free > 0, rest / free)
    return table.withColumn("target", F.when(F.col("clamped"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * level))).select("source", "source_size", "target")


def _join_sources(rows: DataFrame, table: DataFrame, few: bool) -> DataFrame:
    """Rows with what ``table`` has for their source: broadcast if it is small, else met in ``SALT`` parts of each source, so that no hot source lies in one task."""
    right = table.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if few:
        return rows.join(F.broadcast(right), same, "inner").drop("_source")
    spread = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c != "source"]), F.lit(SALT)).cast("int"))
    return salted.join(spread, same & (F.col("_salt") == F.col("_part")), "inner").drop("_source", "_part", "_salt")


def _place(seed: int, id_col: str, text_col: str) -> Column:
    """A document's place in the order of the sample: a hash of seed, id and text."""
    return F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(id_col).isNull(), F.coalesce(F.col(text_col), F.lit("")))


def mix_rows(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies and taken."""
    return _planned(docs, weights, max_epochs, seed, id_col, text_col, source_col).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _planned(docs: DataFrame, weights: tuple[float, ...], max_epochs: int, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """One row per document, with its source and place as well."""
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), _place(seed, id_col, text_col).alias("place")), "mix-rows")
    rows = rows.withColumn("bucket", F.pmod(F.col("place"), F.lit(BUCKETS)))
    sums = stored(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-sums")
    sizes = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    few = sizes.count() <= MOST_SOURCES
    plan = targets(sizes, weights, max_epochs)
    # the guard keeps a rounding error from turning a clamped source into a fraction of its documents
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("whole", F.least(F.floor(epochs + 1e-9), F.lit(max_epochs)).cast("long"))
    plan = plan.withColumn("extra", F.greatest(F.floor(F.col("target") + 0.5).cast("long") - F.col("whole") * F.col("source_size"), F.lit(0).cast("long")))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = _join_sources(sums.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0).cast("long"))), plan, few)
    edge = edge.where((F.col("before") <= F.col("extra")) & (F.col("before") + F.col("words") > F.col("extra"))).select("source", F.col("bucket").alias("edge"), (F.col("extra") - F.col("before")).alias("room"))
    right = edge.withColumnRenamed("source", "_edge_source")
    plan = stored(plan.join(right, F.col("source").eqNullSafe(F.col("_edge_source")), "left").drop("_edge_source"), "mix-plan")
    placed = _join_sources(rows, plan, few)
    inside = Window.partitionBy("source", "bucket").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)  # equal rows are taken together
    at_edge = placed.where(F.col("bucket") == F.col("edge")).withColumn("more", (F.sum("size").over(inside) <= F.col("room")).cast("int"))
    others = placed.where(F.col("edge").isNull() | (F.col("bucket") != F.col("edge"))).withColumn("more", F.when(F.col("edge").isNull(), F.col("extra") > 0).otherwise(F.col("bucket") < F.col("edge")).cast("int"))
    taken = at_edge.unionByName(others).withColumn("copies", F.col("whole") + F.col("more"))
    taken = stored(taken.select("doc_id", "source", "size", "place", "source_size", "target", "whole", "extra", "copies"), "mix-taken")
    # what is left of a source's fraction goes to a few documents that fit: of each class of sizes some
    # candidates, largest first, as long as there is room
    used = taken.groupBy("source").agg((F.first("extra") - F.sum((F.col("copies") - F.col("whole")) * F.col("size"))).alias("gap"))
    fits = _join_sources(taken.where(F.col("copies") == F.col("whole")), used, few).where((F.col("size") > 0) & (F.col("size") < 2 * F.col("gap")) & (F.col("copies") < max_epochs))
    alike = fits.groupBy("source", "place").agg(F.sum("size").alias("size"), F.first("gap").alias("gap")).where(F.col("size") < 2 * F.col("gap"))  # rows that repeat id and text
    classes = alike.groupBy("source", F.floor(F.log2("size")).alias("class"), F.pmod("place", F.lit(CANDIDATES)).alias("slot")).agg(F.max(F.struct("size", "place")).alias("x"), F.min(F.struct("size", "place")).alias("y"), F.first("gap").alias("gap"))
    lists = classes.groupBy("source").agg(F.reverse(F.array_sort(F.array_union(F.collect_list("x"), F.collect_list("y")))).alias("xs"), F.first("gap").alias("gap"))
    none = F.array().cast("array<bigint>")

    def fill(state: Column, x: Column) -> Column:
        fit = x["size"] <= state["room"]
        return F.struct(F.when(fit, state["room"] - x["size"]).otherwise(state["room"]).alias("room"), F.when(fit, F.concat(state["places"], F.array(x["place"]))).otherwise(state["places"]).alias("places"))

    lists = lists.withColumn("held", F.aggregate("xs", F.struct(F.col("gap").alias("room"), none.alias("places")), fill))
    # one more that is too large for what is left, if the target is then nearer
    more = F.filter("xs", lambda x: (x["size"] < 2 * F.col("held.room")) & (x["size"] > F.col("held.room")) & ~F.array_contains("held.places", x["place"]))
    chosen = F.array_compact(F.concat("held.places", F.array(F.array_min(more)["place"])))
    closing = lists.select(F.col("source").alias("_source"), F.explode(chosen).alias("_place"))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("place") == F.col("_place"))
    # at most 128 * CANDIDATES rows a source
    final = taken.join(F.broadcast(closing) if few else closing, same, "left")
    final = final.withColumn("copies", F.col("copies") + ((F.col("copies") == F.col("whole")) & F.col("_place").isNotNull()).cast("long"))
    return final.select("doc_id", "source", "place", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents, each as many times as the mix takes it, with all their columns.

    Rows find their number by source and place, which equal rows share and no others
    (but for a clash of 64-bit hashes within a source).
    """
    place, source, copies, copy = (unused(docs, c) for c in ("mix_place", "mix_source", "mix_copies", "mix_copy"))
    plan = _planned(docs, weights, max_epochs, seed, id_col, text_col, source_col).where("copies > 0")
    plan = plan.groupBy(F.col("source").alias(source), F.col("place").alias(place)).agg(F.max("copies").alias(copies))
    own = _place(seed, id_col, text_col)
    joined = docs.join(plan, (own == F.col(place)) & F.col(source_col).cast("string").eqNullSafe(F.col(source)))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])
