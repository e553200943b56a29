"""Exact dedup by a tree-merge of sorted digest runs.

Each partition turns its texts into one sorted run of digests, copies already
folded together.  Runs are then exchanged in rounds of a binomial tree: in each
round the runs whose numbers agree after division by ``FAN_IN`` meet, one digest
range at a time, are merged (by Spark's external sort of what meets, which can't
take runs as they are) and folded again, so that the best identifier and the number
of copies of every text rise one level.
Digest ranges are independent trees, hence no task ever sees more than its
range, and a group of copies counts as one entry a run.

Digests are SHA-256 of the text with A-Z lower-cased; beside each lie the text's
length and a 64-bit hash of another family, which must agree as well before two
entries are folded at any level.

Defined cases: a null text is an empty one; empty texts equal each other; null
ids lose against any other id; rows that repeat an id and its text are copies of
one document: all of them are counted, and all are kept or dropped together;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm._joins import join_even, unused
from orrery.llm._text import body
from orrery.storage import in_arrow, release, stored

FAN_IN = 2
RUNS = 64
RANGES = 1024
ENTRY = "span int, run int, digest binary, proof binary, keep_id long, group_size long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, proofs = [], []
        for text in batch.column("body"):
            low = text.as_py().lower()
            digests.append(hashlib.sha256(low).digest())
            proofs.append(len(low).to_bytes(8, "big") + xxhash.xxh3_64_digest(low))
        yield pa.record_batch([batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(proofs, pa.binary())], names=["doc_id", "digest", "proof"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest and proof of every text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col)).transform(in_arrow, _digest, "doc_id long, digest binary, proof binary")


def _fold(keep_largest: bool):
    """Fold equal neighbours of sorted entries; an entry that ends a batch waits for the next."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: pa.Table | None = None
        for batch in batches:
            table = pa.table(batch.columns, names=batch.schema.names)
            if wait is not None:
                table = pa.concat_tables([wait, table]).combine_chunks()
            if not table.num_rows:
                continue
            # digests and proofs have one size each, so neighbours are compared as rows of bytes
            keys = [np.frombuffer(b"".join(table[c].to_pylist()), np.uint8).reshape(table.num_rows, -1) for c in ("digest", "proof")]
            keys += [table[c].to_numpy()[:, None] for c in ("span", "run")]
            first = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([(k[1:] != k[:-1]).any(axis=1) for k in keys])]))
            ids = table["keep_id"].to_numpy(zero_copy_only=False)
            known = np.ones(len(ids), bool) if table["keep_id"].null_count == 0 else ~np.asarray(table["keep_id"].is_null())
            worst = np.iinfo(np.int64).min if keep_largest else np.iinfo(np.int64).max
            ids = np.where(known, np.asarray(table["keep_id"].fill_null(worst)), worst) if not known.all() else ids.astype(np.int64)
            best = (np.maximum if keep_largest else np.minimum).reduceat(ids, first)
            any_known = np.logical_or.reduceat(known, first)
            sizes = np.add.reduceat(table["group_size"].to_numpy(), first)
            out = table.take(first).set_column(4, "keep_id", pa.array(best, pa.int64(), mask=~any_known)).set_column(5, "group_size", pa.array(sizes, pa.int64()))
            wait = out.slice(out.num_rows - 1)
            yield from out.slice(0, out.num_rows - 1).combine_chunks().to_batches()
        if wait is not None:
            yield from wait.combine_chunks().to_batches()

    return fold


def merge_runs(marks: DataFrame, keep: str = "largest") -> DataFrame:
    """digest, proof, keep_id and group_size of every distinct text: the root of the tree."""
    fold = _fold(keep == "largest")
    span = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") * RANGES / (1 << 32)
    runs = marks.select(
        span.cast("int").alias("span"), F.pmod(F.spark_partition_id(), F.lit(RUNS)).cast("int").alias("run"), "digest", "proof", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")
    )
    order = ["span", "run", "digest", "proof"]
    runs = runs.sortWithinPartitions(*order).transform(in_arrow, fold, ENTRY)
    left = RUNS
    while left > 1:
        left = -(-left // FAN_IN)
        runs = runs.withColumn("run", F.floor(F.col("run") / FAN_IN).cast("int")).repartition("span", "run").sortWithinPartitions(*order).transform(in_arrow, fold, ENTRY)
    return runs.select("digest", "proof", "keep_id", "group_size")


def exact_groups(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` is ``largest`` or ``smallest``: the id that stays of equal texts.
    """
    marks = stored(digests(docs, id_col, text_col), "digests")
    release(docs.sparkSession)  # the plan of the rounds is large: the driver starts it, and goes on, without garbage
    groups = stored(merge_runs(marks, keep), "groups")
    release(docs.sparkSession)
    total = marks.count()
    key = F.concat("digest", "proof").alias("key")
    joined = join_even(marks.select("doc_id", "digest", key), groups.select(key, "keep_id", "group_size"), "key", "group_size", total)
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def dedup_exact(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns, whatever they are called.

    Rows that repeat both id and text stay together.
    """
    kept_id, kept_sha = unused(docs, "kept_id"), unused(docs, "kept_sha")
    kept = exact_groups(docs, keep, id_col, text_col).where("kept").select(F.col("doc_id").alias(kept_id), F.unhex("text_sha256").alias(kept_sha)).distinct()
    low = F.unhex(F.sha2(F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), 256))
    return docs.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(kept_id)) & (low == F.col(kept_sha)), "left_semi")
