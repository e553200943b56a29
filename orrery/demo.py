"""The declared model over the sample tables: customers, orders, items, events and the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.plans.schema import Entity, Registry, Relation
from orrery.sources.dataset import Dataset

LINEITEM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def next_events(data) -> DataFrame:
    """Edges from each event to the next of the same user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return data.frame("Event").select(F.col("event_id").alias("src"), F.lead("event_id").over(w).alias("dst")).where("dst is not null")


def registry() -> Registry:
    party = Entity("Party", attributes=("name", "nationkey", "acctbal"), template=True, plural="parties", doc="Whoever trades: a customer or a supplier.")
    out = Registry().add(
        Entity("Region", "region", ("r_regionkey",), ("r_regionkey", "r_name"), default="r_name"),
        Entity("Nation", "nation", ("n_nationkey",), ("n_nationkey", "n_name", "n_regionkey"), default="n_name"),
        party,
        Entity("Customer", "customer", ("c_custkey",), ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), is_a="Party", rename=(("c_name", "name"), ("c_nationkey", "nationkey"), ("c_acctbal", "acctbal"))),
        Entity("Supplier", "supplier", ("s_suppkey",), ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), is_a="Party", rename=(("s_name", "name"), ("s_nationkey", "nationkey"), ("s_acctbal", "acctbal"))),
        Entity("Part", "part", ("p_partkey",), ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")),
        Entity("Order", "orders", ("o_orderkey",), ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")),
        Entity("Lineitem", "lineitem", LINEITEM, LINEITEM, doc="Identified by its whole row: nothing smaller is unique."),
        Entity("Event", "events", ("event_id",), ("event_id", "ts", "user_id", "event_type", "value", "props")),
        Entity("Document", "documents", ("doc_id",), ("doc_id", "text", "lang", "source", "n_chars")),
        Entity("Label", "labels", ("label_doc",), ("label_doc", "quality", "toxic")),
        Entity("Vector", "embeddings", ("vec_id",), ("vec_id", "label"), products=("embedding",)),
        Entity("Conversation", "conversations", ("conv_id",), ("conv_id",)),
        Entity("Turn", "conversations", ("turn_conv", "turn"), ("turn_conv", "turn", "role", "said")),
    )
    return out.relate(
        Relation("Region", "Nation", ("n_regionkey",)),
        Relation("Nation", "Party", ("nationkey",)),
        Relation("Customer", "Order", ("o_custkey",)),
        Relation("Order", "Lineitem", ("l_orderkey",)),
        Relation("Part", "Lineitem", ("l_partkey",)),
        Relation("Supplier", "Lineitem", ("l_suppkey",)),
        Relation("Customer", "Event", ("user_id",)),
        Relation("Event", "Event", name="next_event", edges=next_events, minimum=0, one2one=True),
        Relation("Document", "Label", ("label_doc",), one2one=True, children=(0, 1)),
        Relation("Conversation", "Turn", ("turn_conv",), ordered="turn"),
    )


def _labels(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/labels.parquet").withColumnRenamed("doc_id", "label_doc")


def _conversations(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/conversations.parquet").select("conv_id").distinct()


def _turns(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/conversations.parquet").select(F.col("conv_id").alias("turn_conv"), "turn", "role", F.col("text").alias("said"))


def open_dataset(spark: SparkSession, root: str) -> Dataset:
    """The sample tables as a dataset."""
    return Dataset(spark, root, registry(), {"Label": _labels, "Conversation": _conversations, "Turn": _turns})
