"""Registered queries over the sample tables, each with its SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery import functions as fn
from orrery.demo import LINEITEM, next_events, open_dataset
from orrery.operators import upsert as up
from orrery.operators import validate as check
from orrery.operators.combine import align, cross, join, split
from orrery.operators.discover import attributes, branch, explain, find, match, match_edges, objects, pattern, related_to_all, without
from orrery.operators.results import apply, filtered, masked, page
from orrery.plans.schema import Relation
from orrery.sources import files as fs
from orrery.sources.dataset import Dataset
from orrery.sources.ingest import Reader, Store, constraints
from orrery.storage import new_path

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a dataset under its name."""

    def put(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(open_dataset(spark, sf_dir))
            return out if isinstance(out, DataFrame) else out.to_df()

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# --- scans, projection, tables ---------------------------------------------------
@query("SELECT n_nationkey, n_name FROM nation")
def scan_attr(data):
    return data.nations[["n_nationkey", "n_name"]]


@query("SELECT c_name FROM customer")
def attribute_start(data):
    return data.c_name


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def traverse_up(data):
    o = data.orders
    return o[["o_orderkey", {"c_name": o.customer.c_name}, {"n_name": o.customer.nation.n_name}, {"r_name": o.customer.nation.region.r_name}]]


@query("SELECT o_orderkey, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def attr_inferred(data):
    return data.orders[["o_orderkey", "r_name"]]


@query("SELECT l_orderkey, l_linenumber, n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey")
def attr_inferred_diamond(data):
    return data.lineitems[["l_orderkey", "l_linenumber", "n_name"]]


@query("SELECT n.n_name FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey")
def traverse_down_bag(data):
    return data.nations.customers.nation.n_name


@query("SELECT c_custkey AS key, c_name AS customer FROM customer")
def table_rename(data):
    return data.customers[[{"key": "c_custkey"}, {"customer": "c_name"}]]


@query("SELECT o_orderkey, c_custkey AS cust_c_custkey, c_name AS cust_c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def table_prefix(data):
    o = data.orders
    return o[["o_orderkey", {"cust_": o.customer[["c_custkey", "c_name"]]}]]


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def table_star(data):
    return data.suppliers["*"]


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def table_append(data):
    p = data.parts
    return p[["p_partkey", "p_name"]] + p[["p_size", "p_retailprice"]]


@query("SELECT c_custkey AS c_custkey0, c_custkey AS c_custkey1 FROM customer")
def table_duplicate_names(data):
    return data.customers[["c_custkey", "c_custkey"]]


@query("""SELECT o_orderkey, coalesce(parts, []) AS parts, coalesce(quantities, []) AS quantities FROM orders LEFT JOIN (
  SELECT l_orderkey, list(l_partkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity) AS parts, list(l_quantity ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity) AS quantities FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def nested_list_table(data):
    o = data.orders
    return o[["o_orderkey", {"parts": o.lineitems.l_partkey}, {"quantities": o.lineitems.l_quantity}]]


@query("SELECT r_name, (SELECT list(n_name ORDER BY n_nationkey) FROM nation) AS nations FROM region")
def unrelated_list_column(data):
    return data.regions[["r_name", {"nations": data.nations.n_name}]]


# --- filters ----------------------------------------------------------------------
@query("SELECT p_partkey, p_size FROM part WHERE p_size > 25")
def mask_cmp(data):
    p = data.parts
    return p[p.p_size > 25][["p_partkey", "p_size"]]


@query("SELECT p_partkey FROM part WHERE (p_size > 25 AND NOT (p_brand = 'Brand#11')) OR p_retailprice < 1000")
def mask_logic(data):
    p = data.parts
    return p[(p.p_size > 25) & ~(p.p_brand == "Brand#11") | (p.p_retailprice < 1000)].p_partkey


@query("SELECT p_partkey FROM part WHERE (p_size > 25) <> (p_retailprice > 1200)")
def mask_xor(data):
    p = data.parts
    return p[(p.p_size > 25) ^ (p.p_retailprice > 1200)].p_partkey


@query("SELECT p_partkey, p_size & 7 AS low, p_size | 8 AS high, xor(p_size, 5) AS mixed FROM part")
def bitwise_int(data):
    p = data.parts
    return p[["p_partkey", {"low": p.p_size & 7}, {"high": p.p_size | 8}, {"mixed": p.p_size ^ 5}]]


@query("SELECT p_partkey, p_type FROM part WHERE regexp_full_match(p_type, '.*E.*')")
def regex_full(data):
    p = data.parts
    return p[p.p_type == "/.*E.*/"][["p_partkey", "p_type"]]


@query("SELECT p_partkey, p_type FROM part WHERE NOT regexp_full_match(p_type, '.*E.*')")
def regex_not(data):
    p = data.parts
    return p[p.p_type != ".*E.*"][["p_partkey", "p_type"]]


@query("SELECT o_totalprice FROM orders WHERE o_totalprice > 200000")
def attr_mask(data):
    price = data.orders.o_totalprice
    return price[price > 200000].alias("o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 42")
def id_lookup(data):
    return data.customers[42].orders.o_orderkey


@query("SELECT c_custkey, c_name FROM customer JOIN (VALUES (3), (1), (3)) v(k) ON c_custkey = k")
def ids_bag(data):
    return data.customers[[3, 1, 3]][["c_custkey", "c_name"]]


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)")
def exists_filter(data):
    c = data.customers
    return c[fn.exists(c.events, wrt=c)].c_custkey


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)")
def not_exists_filter(data):
    c = data.customers
    return c[~fn.exists(c.events, wrt=c)].c_custkey


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def filter_by_global(data):
    o = data.orders
    return o[o.o_totalprice > fn.mean(o.o_totalprice)].o_orderkey


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
def argmax_rows(data):
    o = data.orders
    return o[fn.max(o.o_totalprice) == o.o_totalprice][["o_orderkey", "o_totalprice"]]


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 2")
def slice_per_parent(data):
    return data.customers.orders[:2][["o_orderkey", "o_custkey"]]


# --- aggregates -------------------------------------------------------------------
@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def count_wrt(data):
    c = data.customers
    return c[["c_custkey", {"n": fn.count(c.orders, wrt=c)}]]


@query("""SELECT c_custkey, count(o_orderkey) AS n, round(avg(o_totalprice), 4) AS avg_price FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY c_custkey""")
def flagship(data):
    c = data.customers
    orders = c.orders
    pending = orders[orders.o_orderstatus == "O"]
    return c[["c_custkey", {"n": fn.count(pending, wrt=c)}, {"avg_price": fn.round(fn.mean(pending.o_totalprice, wrt=c), 4)}]]


@query("SELECT c_custkey, CAST(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 0) AS BIGINT) AS f FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def sum_bool_wrt(data):
    c = data.customers
    return c[["c_custkey", {"f": fn.sum(c.orders.o_orderstatus == "F", wrt=c)}]]


@query("""SELECT c_custkey, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 4) AS mean, round(CASE WHEN count(o_totalprice) < 2 THEN 0.0 ELSE stddev_samp(o_totalprice) END, 3) AS std
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def min_max_mean_std(data):
    c = data.customers
    p = c.orders.o_totalprice
    return c[["c_custkey", {"lo": fn.min(p, wrt=c)}, {"hi": fn.max(p, wrt=c)}, {"mean": fn.round(fn.mean(p, wrt=c), 4)}, {"std": fn.round(fn.std(p, wrt=c), 3)}]]


@query("""SELECT o_orderkey, coalesce(bool_or(l_discount > 0.05), false) AS some, coalesce(bool_and(l_discount > 0.05), true) AS every
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 40 GROUP BY o_orderkey""")
def any_all_wrt(data):
    o = data.orders
    items = o.lineitems
    big = items[items.l_quantity > 40]
    return o[["o_orderkey", {"some": fn.any(big.l_discount > 0.05, wrt=o)}, {"every": fn.all(big.l_discount > 0.05, wrt=o)}]]


@query("SELECT c_custkey, coalesce(list_sort(list(o_orderstatus) FILTER (WHERE o_orderstatus IS NOT NULL)), []) AS statuses FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def array_list(data):
    c = data.customers
    return c[["c_custkey", {"statuses": fn.array(c.orders.o_orderstatus, wrt=c)}]]


@query("SELECT c_custkey, coalesce(list_sort(list(DISTINCT o_orderstatus) FILTER (WHERE o_orderstatus IS NOT NULL)), []) AS statuses FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def array_distinct(data):
    c = data.customers
    return c[["c_custkey", {"statuses": fn.array(c.orders.o_orderstatus, wrt=c, distinct=True)}]]


@query("""SELECT o_orderkey, CAST(len(x) AS INTEGER) AS n, CAST(len([v FOR v IN x IF v IS NULL]) AS INTEGER) AS nulls FROM (
  SELECT o_orderkey, list(CASE WHEN l_quantity > 25 THEN l_quantity END) AS x FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)""")
def array_nulls(data):
    o = data.orders
    items = o.lineitems
    held = o[["o_orderkey", {"x": fn.array(items[items.l_quantity > 25].l_quantity, wrt=o, nulls=True)}]].to_df()
    return held.select("o_orderkey", F.size("x").alias("n"), F.size(F.filter("x", F.isnull)).alias("nulls"))


@query("SELECT n_name, round(avg(m), 4) AS mean_of_means FROM nation LEFT JOIN (SELECT c_nationkey, avg(o_totalprice) AS m FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey, c_custkey) ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey")
def agg_of_agg(data):
    n = data.nations
    c = n.customers
    return n[["n_name", {"mean_of_means": fn.round(fn.mean(fn.mean(c.orders.o_totalprice, wrt=c), wrt=n), 4)}]]


@query("""SELECT r_name, CAST(max(s) AS BIGINT) AS top FROM (SELECT r_name, n_nationkey, sum(k) AS s FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN (
  SELECT c_nationkey, c_custkey, count(o_orderkey) AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey, c_custkey) ON c_nationkey = n_nationkey GROUP BY r_name, n_nationkey) GROUP BY r_name""")
def agg3(data):
    r = data.regions
    n = r.nations
    c = n.customers
    return r[["r_name", {"top": fn.max(fn.sum(fn.count(c.orders, wrt=c), wrt=n), wrt=r)}]]


@query("SELECT round(avg(o_totalprice), 4) AS mean_price FROM orders")
def global_agg(data):
    return fn.round(fn.mean(data.orders.o_totalprice), 4).alias("mean_price")


@query("SELECT l_orderkey, l_quantity FROM (SELECT *, avg(l_quantity) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) WHERE l_quantity > m")
def child_vs_parent_agg(data):
    o = data.orders
    items = o.lineitems
    return items[items.l_quantity > fn.mean(items.l_quantity, wrt=o)][["l_orderkey", "l_quantity"]]


@query("SELECT c_custkey, round(sum(o_totalprice) / c_acctbal, 4) AS ratio FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal <> 0 GROUP BY c_custkey, c_acctbal")
def mixed_level(data):
    c = data.customers
    rich = c[c.c_acctbal != 0]
    price = rich.orders.o_totalprice
    total = fn.switch(fn.count(price, wrt=rich) > 0, fn.sum(price, wrt=rich))  # null where no price is known, as in SQL
    buyers = rich[fn.exists(rich.orders, wrt=rich)]  # the inner join's customers
    return buyers[["c_custkey", {"ratio": fn.round(total / rich.c_acctbal, 4)}]]


@query("SELECT c_custkey, count(DISTINCT o_orderpriority) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def count_distinct_wrt(data):
    c = data.customers
    return c[["c_custkey", {"n": fn.count(c.orders.o_orderpriority, wrt=c, distinct=True)}]]


# --- scalars ----------------------------------------------------------------------
@query("""SELECT c_custkey, round(exp(c_acctbal / 10000), 6) AS e, round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 6) AS l, round(CASE WHEN c_acctbal > 0 THEN log10(c_acctbal) END, 6) AS l10,
round(CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END, 6) AS q, CAST(sign(c_acctbal) AS DOUBLE) AS s, abs(c_acctbal) AS a, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(ceil(c_acctbal) AS BIGINT) AS c,
-c_acctbal AS neg, round(c_acctbal / nullif(c_nationkey, 0), 6) AS d, round(pow(c_acctbal / 1000, 2), 6) AS p, CAST(trunc(c_acctbal) AS BIGINT) AS i FROM customer""")
def scalar_math(data):
    c = data.customers
    b = c.c_acctbal
    return c[["c_custkey", {"e": fn.round(fn.exp(b / 10000), 6), "l": fn.round(fn.log(b), 6), "l10": fn.round(fn.log10(b), 6), "q": fn.round(fn.sqrt(b), 6), "s": fn.sign(b), "a": abs(b), "f": fn.floor(b), "c": fn.ceil(b), "neg": -b, "d": fn.round(b / c.c_nationkey, 6), "p": fn.round((b / 1000) ** 2, 6), "i": fn.to_int(b)}]]


@query("SELECT c_custkey, c_name || '/' || c_mktsegment AS label, upper(c_mktsegment) AS up, lower(c_name) AS low FROM customer")
def string_functions(data):
    c = data.customers
    return c[["c_custkey", {"label": c.c_name + "/" + c.c_mktsegment, "up": fn.upper(c.c_mktsegment), "low": fn.lower(c.c_name)}]]


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN o_totalprice WHEN 'O' THEN 0.0 ELSE -1.0 END AS v FROM orders")
def switch_case(data):
    o = data.orders
    return o[["o_orderkey", {"v": fn.switch(o.o_orderstatus, {"F": o.o_totalprice, "O": 0.0}, -1.0)}]]


@query("SELECT l_orderkey, l_linenumber, round(l_quantity + l_extendedprice + l_tax + 1, 4) AS total FROM lineitem")
def reduce_fold(data):
    i = data.lineitems
    return i[["l_orderkey", "l_linenumber", {"total": fn.round(fn.reduce(lambda a, b: a + b, [i.l_quantity, i.l_extendedprice, i.l_tax], 1), 4)}]]


@query("SELECT n_name, count(*) FILTER (WHERE doc IS NULL) > 0 AS lacking FROM nation LEFT JOIN (SELECT c_nationkey, min(event_id) AS doc FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_nationkey, c_custkey) ON c_nationkey = n_nationkey GROUP BY n_name")
def null_test(data):
    n = data.nations
    c = n.customers
    return n[["n_name", {"lacking": fn.any(fn.isnull(fn.min(c.events.event_id, wrt=c)), wrt=n)}]]


# --- combining --------------------------------------------------------------------
UPLOAD = pd.DataFrame({"k": [1, 1, 2, 999999], "tag": ["a", "b", "c", "z"]})


@query("SELECT c_custkey, tag FROM customer JOIN (VALUES (1, 'a'), (1, 'b'), (2, 'c'), (999999, 'z')) v(k, tag) ON c_custkey = k")
def upload_join_table(data):
    rows, c = join(UPLOAD, "k", data.customers, data.customers.c_custkey)
    return c[["c_custkey", {"tag": rows["tag"]}]]


@query("SELECT c_custkey, tag FROM customer LEFT JOIN (VALUES (1, 'a'), (1, 'b'), (2, 'c'), (999999, 'z')) v(k, tag) ON c_custkey = k")
def upload_join_object(data):
    rows, c = join(UPLOAD, "k", data.customers, data.customers.c_custkey, how="left_object")
    return c[["c_custkey", {"tag": rows["tag"]}]]


@query("SELECT c_custkey, tag FROM customer RIGHT JOIN (VALUES (1, 'a'), (1, 'b'), (2, 'c'), (999999, 'z')) v(k, tag) ON c_custkey = k")
def upload_join_rows(data):
    rows, c = join(UPLOAD, "k", data.customers, data.customers.c_custkey, how="left_table")
    return c[["c_custkey", {"tag": rows["tag"]}]]


@query("SELECT c_mktsegment, c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment, c_custkey")
def split_by_segment(data):
    return split(data.customers, "c_mktsegment").then(lambda c: c[["c_custkey", {"n": fn.count(c.orders, wrt=c)}]])


@query("""SELECT c_custkey, coalesce(f, 0) AS f_count, coalesce(o, 0) AS o_count FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS f FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a ON a.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS o FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON b.o_custkey = c_custkey""")
def align_two(data):
    c = data.customers
    orders = c.orders
    both = align(f=orders[orders.o_orderstatus == "F"], o=orders[orders.o_orderstatus == "O"])
    return c[["c_custkey"]] + both.apply(lambda x: fn.count(x, wrt=c)).table(c)


@query("SELECT DISTINCT o_orderpriority FROM orders")
def distinct_rows(data):
    return page(data.orders.o_orderpriority.to_df(), None, distinct=True)


@query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 10")
def skip_limit(data):
    return page(data.customers.c_custkey.to_df(), 20, 10)


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross_startless(data):
    r = data.regions
    both = cross(r, data.nations)
    return both[[{"r_name": r.r_name}, "n_name"]]


@query("SELECT name, acctbal FROM (SELECT c_name AS name, c_acctbal AS acctbal FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier)")
def template_union(data):
    return data.parties[["name", "acctbal"]]


@query("SELECT n_name, count(x) AS parties FROM nation LEFT JOIN (SELECT c_nationkey AS k, 1 AS x FROM customer UNION ALL SELECT s_nationkey, 1 FROM supplier) ON k = n_nationkey GROUP BY n_name, n_nationkey")
def template_traverse(data):
    n = data.nations
    return n[["n_name", {"parties": fn.count(n.parties, wrt=n)}]]


@query("SELECT event_id, nxt FROM (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL")
def relative_edge(data):
    e = data.events
    held = e[["event_id", {"nxt": e.next_event.event_id}]].to_df()
    return held.where("nxt is not null")


@query("SELECT d.doc_id, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def optional_one2one(data):
    d = data.documents
    return d[["doc_id", {"toxic": d.label.toxic}]]


@query("SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def ordered_relation(data):
    c = data.conversations
    return c[["conv_id", {"roles": c.turns.role}]]


@query("SELECT vec_id, embedding FROM embeddings WHERE label = 3")
def product_column(data):
    v = data.vectors
    return v[v.label == 3][["vec_id", "embedding"]]


@query("SELECT src, dst FROM (SELECT event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL AND src % 2 = 0")
def relative_of_masked(data):
    e = data.events
    even = e[(e.event_id & 1) == 0]
    held = even[[{"src": "event_id"}, {"dst": even.next_event.event_id}]].to_df()
    return held.where("dst is not null")


@query("""SELECT l_suppkey FROM (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem) GROUP BY l_suppkey HAVING count(*) FILTER (WHERE l_returnflag IN (SELECT DISTINCT l_returnflag FROM lineitem WHERE l_quantity > 49)) = (SELECT count(DISTINCT l_returnflag) FROM lineitem WHERE l_quantity > 49)""")
def pattern_all_of(data):
    items = data.frame("Lineitem")
    return related_to_all(items, "l_suppkey", "l_returnflag", items.where("l_quantity > 49"))


@query("""WITH e AS (SELECT event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events)
SELECT a.src AS n0, a.dst AS n1, b.dst AS n2 FROM e a JOIN e b ON a.dst = b.src WHERE b.dst IS NOT NULL""")
def pattern_branch(data):
    edges = next_events(data)
    return branch(edges, edges)


# --- writing and checking ---------------------------------------------------------
TARGET = [(1, "x", None), (2, "y", 5)]
SOURCE = [(2, "Y", 6), (1, None, 7), (3, "n", None)]
_T = "(VALUES (1, 'x', NULL), (2, 'y', 5)) t(k, name, v)"
_S = "(VALUES (2, 'Y', 6), (1, NULL, 7), (3, 'n', NULL)) s(k, name, v)"


def _two(data) -> tuple[DataFrame, DataFrame]:
    kind = "k int, name string, v int"
    return data.spark.createDataFrame(TARGET, kind), data.spark.createDataFrame(SOURCE, kind)


@query(f"SELECT coalesce(t.k, s.k) AS k, coalesce(t.name, s.name) AS name, coalesce(t.v, s.v) AS v FROM {_T} FULL JOIN {_S} ON t.k = s.k")
def upsert_ignore(data):
    return up.upsert(*_two(data), ["k"], "ignore", stamps=False)[0]


@query(f"SELECT coalesce(t.k, s.k) AS k, coalesce(s.name, t.name) AS name, coalesce(s.v, t.v) AS v FROM {_T} FULL JOIN {_S} ON t.k = s.k")
def upsert_overwrite(data):
    return up.upsert(*_two(data), ["k"], "overwrite", stamps=False)[0]


@query(f"""SELECT s.k, c AS "column", o AS old, n AS new FROM (SELECT s.k, 'name' AS c, t.name AS o, s.name AS n FROM {_T} JOIN {_S} ON t.k = s.k UNION ALL
SELECT s.k, 'v', CAST(t.v AS VARCHAR), CAST(s.v AS VARCHAR) FROM {_T} JOIN {_S} ON t.k = s.k) s WHERE o IS DISTINCT FROM n""")
def upsert_track(data):
    return up.upsert(*_two(data), ["k"], "track", now=0)[1].drop("at")


@query("SELECT l_orderkey, l_partkey, CASE WHEN l_tax > 0.04 THEN l_suppkey END AS extra FROM lineitem GROUP BY ALL")
def relational_identity(data):
    rows = data.frame("Lineitem").select("l_orderkey", "l_partkey", F.when(F.col("l_tax") > 0.04, F.col("l_suppkey")).alias("extra"))
    merged, _ = up.merge_dependent(rows.limit(0), rows, ["l_orderkey"], ["l_partkey"], ["extra"])
    return merged.select("l_orderkey", "l_partkey", "extra")


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS version FROM orders")
def version_assign(data):
    rows = data.frame("Order").select("o_custkey", "o_orderkey", F.lit(None).cast("int").alias("version"))
    return up.set_version(rows, ["o_custkey"], ["o_orderkey"])


@query("""SELECT user_id, min(event_id) AS "start", max(event_id) AS "end" FROM (SELECT user_id, event_id, event_id - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events) GROUP BY user_id, g""")
def completion_intervals(data):
    return up.intervals(data.frame("Event"), ["user_id"], "event_id")


@query("SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING count(l_orderkey) NOT BETWEEN 1 AND 7")
def validate_cardinality(data):
    return check.cardinality(data.frame("Order"), data.frame("Lineitem"), ["o_orderkey"], ["l_orderkey"], 1, 7)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def validate_unique_identity(data):
    return check.unique_identity(data.frame("Lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_partkey, l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def validate_duplicates(data):
    return check.duplicate_edges(data.frame("Lineitem").select("l_partkey", "l_suppkey", "l_linenumber"))


@query("SELECT l_orderkey, l_partkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_linenumber) > 1")
def validate_order_only(data):
    return check.edges_differing_by_order(data.frame("Lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), "l_linenumber")


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) <> 1")
def validate_constrain(data):
    return check.constrained(data.frame("Lineitem"), ["l_orderkey"], "l_returnflag")


@query("SELECT o_orderkey, count(c_custkey) AS n FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3) ON c_custkey = o_custkey GROUP BY o_orderkey HAVING count(c_custkey) <> 1")
def validate_relation(data):
    fewer = Dataset(data.spark, data.root, data.registry, {"Customer": lambda spark, root: spark.read.parquet(f"{root}/customer.parquet").where("c_custkey % 10 <> 3")})
    return check.relation(fewer, Relation("Customer", "Order", ("o_custkey",)))


@query("SELECT s.event_id AS src, s.nxt AS dst FROM (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) s WHERE nxt IS NOT NULL")
def edge_frame(data):
    return next_events(data)


# --- names, masks and results ------------------------------------------------------
@query("SELECT event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS event_id FROM events QUALIFY event_id IS NOT NULL AND lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT NULL")
def relative_start(data):
    e = data.events
    return e[[{"src": "event_id"}, {"event_id": e.next_event.event_id}]].to_df().where("event_id is not null")


@query("SELECT c_name FROM customer WHERE c_custkey > 100")
def column_pick(data):
    c = data.customers
    return c[c.c_custkey > 100][["c_custkey", {"label": "c_name"}]]["label"].alias("c_name")


@query("SELECT c_custkey AS key_, c_name AS name_x, c_acctbal AS acctbal_x FROM customer")
def table_suffix(data):
    c = data.customers
    return c[[{"key_": "c_custkey"}, {"_x": c[[{"name": "c_name"}, {"acctbal": "c_acctbal"}]]}]]


@query("SELECT o_orderkey, c_name, c_acctbal FROM orders JOIN customer ON c_custkey = o_custkey")
def stacked_unprefixed(data):
    o = data.orders
    return o[[o[["o_orderkey"]], o.customer[["c_name", "c_acctbal"]]]]


@query("SELECT n_nationkey FROM nation WHERE n_name = 'FRANCE'")
def object_equality(data):
    n = data.nations
    return n[n == "FRANCE"].n_nationkey


@query("SELECT c_custkey, c_nationkey = 7 AS flag FROM customer")
def internal_id(data):
    c = data.customers
    return c[["c_custkey", {"flag": fn.object_id(c.nation) == 7}]]


@query("SELECT c_custkey, isnan(c_acctbal) AS bad FROM customer")
def isnan_test(data):
    c = data.customers
    return c[["c_custkey", {"bad": fn.isnan(c.c_acctbal)}]]


@query("SELECT c_name AS name FROM customer WHERE c_acctbal < 0")
def filter_by_type(data):
    p = data.parties
    only = p.of_type("Customer")
    return only[only.acctbal < 0].name


@query("SELECT r_name, count(*) FILTER (WHERE n_name LIKE 'A%' OR n_name LIKE 'I%') AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def mask_below_aggregate(data):
    r = data.regions
    n = r.nations
    return r[["r_name", {"n": fn.count(n[(n.n_name == "/A.*/") | (n.n_name == "/I.*/")], wrt=r)}]]


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def result_sort(data):
    return data.orders[["o_orderkey", "o_totalprice"]].to_df().orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS kept, CASE WHEN NOT (c_acctbal > 5000) THEN c_acctbal END AS low FROM customer")
def result_masks(data):
    df = data.customers[["c_custkey", {"kept": "c_acctbal"}, {"low": "c_acctbal"}]].to_df()
    return masked(filtered(df, "kept", F.col("kept") > 0), "low", F.col("low") > 5000)


@query("SELECT c_custkey, c_acctbal * 2 AS twice FROM customer")
def result_apply(data):
    df = data.customers[["c_custkey", "c_acctbal"]].to_df()
    return apply(df, lambda pdf: pdf.assign(twice=pdf["c_acctbal"] * 2)[["c_custkey", "twice"]], "c_custkey long, twice double")


@query("SELECT c_custkey FROM customer")
def iterate_rows(data):
    rows = [(int(r["c_custkey"]),) for r in data.customers[["c_custkey"]]]
    return data.spark.createDataFrame(rows, "c_custkey long")


@query("SELECT r_name FROM region ORDER BY r_name LIMIT 1")
def limit_one(data):
    return data.spark.createDataFrame([(str(data.regions.r_name(limit=1)),)], "r_name string")


# --- missing values and levels ------------------------------------------------------
@query("SELECT n_name, round(avg(c_acctbal) FILTER (WHERE c_acctbal <= 709), 4) AS m, count(*) FILTER (WHERE c_acctbal <= 709) AS k FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def nan_mean(data):
    n = data.nations
    b = n.customers.c_acctbal
    odd = fn.switch(b > 709, fn.exp(b * 1000) * 0, b)  # infinity times zero is NaN
    return n[["n_name", {"m": fn.round(fn.mean(odd, wrt=n), 4)}, {"k": fn.count(odd, wrt=n)}]]


def _pets(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/customer.parquet").select(F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey")).alias("pet"), F.col("c_nationkey").alias("owner"), F.col("c_acctbal").alias("weight"))


def _owners(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/nation.parquet").select(F.when(F.col("n_nationkey") != 3, F.col("n_nationkey")).alias("person"), F.col("n_name").alias("called"))


def pets(data) -> Dataset:
    """A dataset whose identities may be missing."""
    from orrery.plans.schema import Entity, Registry

    registry = Registry().add(Entity("Owner", identity=("person",), attributes=("person", "called")), Entity("Pet", identity=("pet",), attributes=("pet", "owner", "weight"))).relate(Relation("Owner", "Pet", ("owner",)))
    return Dataset(data.spark, data.root, registry, {"Owner": _owners, "Pet": _pets})


@query("SELECT n_name AS called, CASE WHEN n_nationkey = 3 THEN 0 ELSE count(c_custkey) END AS n, CASE WHEN n_nationkey = 3 THEN 0 ELSE count(c_custkey) FILTER (WHERE c_acctbal > 0) END AS heavy FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey")
def null_identity_count(data):
    o = pets(data).owners
    p = o.pets
    return o[["called", {"n": fn.count(p, wrt=o)}, {"heavy": fn.count(p[p.weight > 0], wrt=o)}]]


@query("SELECT o_orderkey, o_custkey, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM orders")
def noop_aggregate(data):
    c = data.customers
    o = c.orders
    return o[["o_orderkey", "o_custkey", {"top": fn.max(fn.max(o.o_totalprice, wrt=o), wrt=c)}]]


@query("SELECT CAST(3 AS BIGINT) AS a, CAST(2 AS BIGINT) AS b, 2.0 AS c")
def plain_iterables(data):
    return data.spark.createDataFrame([(fn.sum([1, 2]), fn.count([5, 5, 6], distinct=True), float(fn.mean([1, 3])))], "a long, b long, c double")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size FROM orders")
def switch_condition(data):
    o = data.orders
    return o[["o_orderkey", {"size": fn.switch(o.o_totalprice > 100000, "big", "small")}]]


@query("SELECT c_custkey, replace(c_mktsegment, 'E', '3') AS swapped, c_name || ':' || CAST(c_nationkey AS VARCHAR) AS joined FROM customer")
def text_helpers(data):
    c = data.customers
    return c[["c_custkey", {"swapped": fn.replace(c.c_mktsegment, "E", "3")}, {"joined": fn.append(c.c_name, ":", c.c_nationkey)}]]


@query("SELECT c_custkey, coalesce(list_sort(list(o_totalprice) FILTER (WHERE o_totalprice > 150000)), []) AS big, (list_sort(list(o_totalprice) FILTER (WHERE o_totalprice IS NOT NULL)))[1] AS lowest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def list_filter_element(data):
    c = data.customers
    prices = fn.array(c.orders.o_totalprice, wrt=c)
    return c[["c_custkey", {"big": fn.filtered(prices, lambda x: x > 150000)}, {"lowest": fn.element(prices, 0)}]]


# --- splits, alignment, uploads -----------------------------------------------------
@query("SELECT n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def split_default_key(data):
    return split(data.nations).then(lambda n: n[[{"n": fn.count(n.customers, wrt=n)}]])


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def split_iterate(data):
    rows = [(key[0], int(fn.count(c)())) for key, c in split(data.customers, "c_mktsegment")]
    return data.spark.createDataFrame(rows, "c_mktsegment string, n long")


@query("""SELECT c_custkey, round(coalesce(f, 0) + coalesce(o, 0), 2) AS both_sum, coalesce(f, 0) > 0 AND NOT (coalesce(o, 0) > 100000) AS only_f, round(pow(2, least(coalesce(o, 0) / 1000000, 1)) - 1, 4) AS part FROM customer
LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS f FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a ON a.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS o FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON b.o_custkey = c_custkey""")
def align_operators(data):
    c = data.customers
    o = c.orders
    sums = fn.sum(align(f=o[o.o_orderstatus == "F"], o=o[o.o_orderstatus == "O"]).o_totalprice, wrt=c)
    flags = sums > align(f=c.c_custkey * 0, o=c.c_custkey * 0 + 100000)
    share = 2 ** fn.switch(sums / 1000000 > 1, 1.0, sums / 1000000) - 1
    f, s = sums.members["f"], sums.members["o"]
    return c[["c_custkey", {"both_sum": fn.round(f + s, 2)}, {"only_f": flags.members["f"] & (~flags).members["o"]}, {"part": fn.round(share.members["o"], 4)}]]


@query("SELECT n_name, round(avg(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING'), 4) AS b_mean, round(avg(c_acctbal) FILTER (WHERE c_mktsegment = 'MACHINERY'), 4) AS m_mean FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def align_mean_wrt(data):
    n = data.nations
    c = n.customers
    parts = align(b=c[c.c_mktsegment == "BUILDING"], m=c[c.c_mktsegment == "MACHINERY"])
    means = fn.round(fn.mean(parts.c_acctbal, wrt=align(b=n, m=n)), 4)
    return n[["n_name"]] + means.apply(lambda x: x.alias("mean")).table(n)


@query("SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def align_rows(data):
    n = data.nations
    rows = [(str(a["n_name"]), str(b["r_name"])) for a, b in align(n[["n_nationkey", "n_name"]], n[["n_nationkey", {"r_name": n.region.r_name}]])]
    return data.spark.createDataFrame(rows, "n_name string, r_name string")


TWO_KEYS = pd.DataFrame({"nation": [1, 2, 3, 3], "segment": ["BUILDING", "MACHINERY", "BUILDING", "NONE"], "tag": ["a", "b", "c", "d"], "wide": [1, 2, 3, 4]})


@query("SELECT c_custkey, tag FROM customer JOIN (VALUES (1, 'BUILDING', 'a'), (2, 'MACHINERY', 'b'), (3, 'BUILDING', 'c'), (3, 'NONE', 'd')) v(n, s, tag) ON n = c_nationkey AND s = c_mktsegment")
def upload_two_keys(data):
    c = data.customers
    rows, c = join(TWO_KEYS, ["nation", "segment"], c, [c.c_nationkey, c.c_mktsegment], columns=["tag"])
    return c[["c_custkey", {"tag": rows["tag"]}]]


# --- discovery and patterns ---------------------------------------------------------
@query("SELECT 'customer' AS name")
def find_names(data):
    return data.spark.createDataFrame([(find(data, "custmer", 1)[0],)], "name string")


@query("SELECT unnest(['n_name', 'n_nationkey', 'n_regionkey']) AS name, 'attribute' AS kind UNION ALL SELECT unnest(['customer', 'nation', 'region']), 'object' UNION ALL SELECT 'Order', 'explained'")
def list_names(data):
    rows = [(a, "attribute") for a in attributes(data.nations, own=True)] + [(o, "object") for o in objects(data.orders, many=False) if o in ("customer", "nation", "region")]
    rows.append((explain(data.orders).split("\n")[0].split(":")[0], "explained"))
    return data.spark.createDataFrame(rows, "name string, kind string")


@query("""SELECT c_custkey FROM customer WHERE (SELECT count(DISTINCT o_orderstatus) FROM orders WHERE o_custkey = c_custkey AND o_orderkey IN (1, 2, 3)) >= 0
AND c_nationkey = 7 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7))) AND c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 1e9)""")
def pattern_related(data):
    first = data.nations[7].customers.orders
    smallest = data.orders[data.orders.o_orderkey == fn.min(first.o_orderkey)]
    e = data.events
    dear = e[(e.event_type == "purchase") & (e.value > 1e9)]
    return pattern(data.customers, [data.nations[7], smallest], [dear]).c_custkey


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 5")
def match_rows(data):
    return match(data.frame("Customer"), c_mktsegment="BUILDING", c_nationkey=5).select("c_custkey", "c_name")


@query("SELECT o_custkey AS src, o_orderkey AS dst FROM orders WHERE o_custkey = 7")
def match_edge_rows(data):
    return match_edges(data.frame("Order").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")), src=7)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def without_edges(data):
    return without(data.frame("Customer"), data.frame("Order").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").select("c_custkey")


# --- writing -----------------------------------------------------------------------
_ORDERED = "(SELECT l_orderkey AS k, l_partkey AS part, l_suppkey AS supp, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_quantity, l_linenumber) AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_linenumber DESC) AS z FROM lineitem)"


def _lines(data) -> DataFrame:
    return data.frame("Lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("q"))


@query(f"SELECT k, part, supp, q FROM {_ORDERED} WHERE a = 1")
def upsert_duplicate_source(data):
    rows = _lines(data)
    return up.upsert(rows.limit(0), rows, ["k"], "ignore", stamps=False)[0]


@query(f"SELECT o.o_orderkey AS k, coalesce(part, 0) AS part, supp, q FROM orders o LEFT JOIN {_ORDERED} x ON k = o_orderkey AND z = 1")
def upsert_whole_table(data):
    stored = data.frame("Order").select(F.col("o_orderkey").alias("k"), F.lit(0).cast("long").alias("part"))
    return up.upsert(stored, _lines(data), ["k"], "overwrite", stamps=False)[0]


@query("""SELECT k, 'q' AS "column", count(*) AS n FROM (SELECT DISTINCT l_orderkey AS k, l_quantity AS q, first_value(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS kept FROM lineitem) WHERE q <> kept GROUP BY k""")
def upsert_track_rejected(data):
    rows = data.frame("Lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("q"))
    return up.upsert(rows.limit(0), rows, ["k"], "track", now=0)[1].groupBy("k", "column").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS nation, min(c_acctbal) AS low FROM customer WHERE c_nationkey % 4 <> 0 GROUP BY c_nationkey")
def upsert_null_identity(data):
    rows = data.frame("Customer").select(F.when(F.col("c_nationkey") % 4 != 0, F.col("c_nationkey")).alias("nation"), F.col("c_acctbal").alias("low"))
    return up.upsert(rows.limit(0), rows, ["nation"], missing="drop", stamps=False)[0]


@query("SELECT DISTINCT o_custkey AS src, o_orderpriority AS dst FROM orders WHERE o_custkey % 7 <> 0")
def edges_plain(data):
    edges = data.frame("Order").select(F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("src"), F.col("o_orderpriority").alias("dst"))
    return up.upsert_edges(edges.limit(0), edges)[0].select("src", "dst")


@query("SELECT a, b, min(q) AS q FROM (SELECT l_partkey % 5 AS a, l_suppkey % 5 AS b, l_quantity AS q FROM lineitem) GROUP BY a, b")
def dependent_two_parents(data):
    rows = data.frame("Lineitem").select((F.col("l_partkey") % 5).alias("a"), (F.col("l_suppkey") % 5).alias("b"), F.col("l_quantity").alias("q"))
    return up.merge_dependent(rows.limit(0), rows, [], ["a", "b"])[0].select("a", "b", "q")


@query("SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS src, l_partkey AS dst, 'l_orderkey' AS kind FROM lineitem")
def merge_node_first(data):
    rows = data.frame("Lineitem").select("l_partkey", "l_orderkey")
    none = data.spark.createDataFrame([], "src string, dst struct<l_partkey:bigint>, kind string")
    edges = up.merge_object(rows.select("l_partkey").limit(0), none, rows, ["l_partkey"], ["l_orderkey"], strategy="node")[1]
    return edges.select("src", F.col("dst.l_partkey").alias("dst"), "kind")


@query("SELECT conv_id AS src, role AS dst, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS ord FROM conversations")
def ordered_edge_write(data):
    c = data.conversations
    lists = c[["conv_id", {"roles": c.turns.role}]].to_df()
    return up.ordered_edges(lists, "conv_id", "roles")


@query("SELECT doc_id AS src, toxic AS dst FROM labels UNION SELECT toxic, doc_id FROM labels")
def optional_mirrored(data):
    rows = data.frame("Label").select(F.col("label_doc").alias("a"), F.col("toxic").cast("long").alias("b"))
    none = data.spark.createDataFrame([], "src long, dst long")
    return up.attach(none, rows, "a", "b", mirrored=True).select("src", "dst")


@query("SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def collect_into_lists(data):
    return up.collect_rows(data.frame("Order").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS at FROM orders")
def unwind_lists(data):
    lists = up.collect_rows(data.frame("Order").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")
    return up.unwind(lists, "o_orderkey", index="at")


@query("SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS seen FROM orders GROUP BY o_custkey")
def union_of_lists(data):
    lists = data.frame("Order").select("o_custkey", F.array("o_orderpriority").alias("seen"))
    return up.union_lists(lists, ["o_custkey"], "seen")


@query("SELECT o_custkey, count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders) GROUP BY o_custkey")
def group_to_map(data):
    maps = up.group_map(data.frame("Order"), ["o_custkey"], "o_orderkey", "o_totalprice")
    return up.custom(maps, lambda df: df.select("o_custkey", F.size("map").cast("long").alias("n")))


@query("""SELECT s_suppkey, 's_acctbal' AS "column" FROM supplier WHERE s_suppkey % 3 = 0""")
def violation_report(data):
    stored = data.frame("Supplier").select("s_suppkey", "s_name", "s_acctbal")
    proposed = stored.withColumn("s_acctbal", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")))
    return up.violations(stored, proposed, ["s_suppkey"]).select("s_suppkey", "column")


@query("SELECT o_orderkey FROM orders WHERE o_custkey <= 100")
def restore_to_time(data):
    rows = data.frame("Order").select("o_orderkey", F.col("o_custkey").alias("_dbcreated"))
    return up.restore(rows, 100).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def objects_without_file(data):
    files = data.frame("Customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("_dbcreated"))
    return check.without_file(data.frame("Order").select("o_orderkey", F.col("o_custkey").alias("_dbcreated")), files).select("o_orderkey")


@query("SELECT c_name AS fname FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def absent_file_names(data):
    c = data.customers
    return check.absent_files(data.frame("Customer").select(F.col("c_name").alias("fname")), c[fn.exists(c.orders, wrt=c)][[{"fname": "c_name"}]].to_df())


@query("SELECT 'identity' AS \"check\", unnest(['Customer', 'Order', 'Part']) AS name, CAST(0 AS BIGINT) AS offending")
def validation_report(data):
    return check.report(data).where("check = 'identity' and name in ('Customer', 'Order', 'Part')")


@query("SELECT n_nationkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey HAVING count(s_suppkey) > 1")
def validate_one2one(data):
    return check.reflected(data, Relation("Nation", "Supplier", ("s_nationkey",), one2one=True))


@query("SELECT 'identity' AS kind, unnest(['Order', 'Part']) AS name, unnest(['o_orderkey', 'p_partkey']) AS columns")
def constraint_list(data):
    return constraints(data).where("kind = 'identity' and name in ('Order', 'Part')").select("kind", "name", "columns")


@query("SELECT 'relation' AS kind, unnest(['Customer', 'Part']) AS source, unnest(['Order', 'Lineitem']) AS target")
def class_graph(data):
    graph = data.registry.frame(data.spark).where("kind = 'relation' and (target, name) in (('Customer', 'Order'), ('Part', 'Lineitem'))")
    return graph.select("kind", F.col("target").alias("source"), F.col("name").alias("target"))


# --- files -------------------------------------------------------------------------
@query("SELECT unnest(['nation.parquet', 'region.parquet']) AS fname")
def file_discovery(data):
    return fs.discover(data.spark, data.root, r".*ion\.parquet").select("fname")


@query("SELECT unnest(['nation.parquet', 'region.parquet', 'nation.parquet', 'region.parquet']) AS fname, unnest([0, 0, 1, 1]) AS extn, unnest(['head', 'head', 'data', 'data']) AS part")
def file_parts_manifest(data):
    parts = fs.file_parts(fs.discover(data.spark, data.root, r".*ion\.parquet"), ["head", "data"])
    return parts.join(fs.wrong_parts(parts, 2), "fname", "left_anti").select("fname", "extn", "part")


@query("SELECT n_nationkey, n_name FROM nation")
def text_tables(data):
    path = new_path(data.spark, "text")
    data.frame("Nation").select("n_nationkey", "n_name").write.option("header", True).option("sep", "\t").csv(path)
    return fs.text_table(data.spark, path, sep="\t").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN -1.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def masked_round_trip(data):
    path = new_path(data.spark, "masked")
    held = data.frame("Customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, -1.0).otherwise(F.col("c_acctbal")).alias("c_acctbal"))
    fs.write_masked(held, path, {"c_acctbal": -1.0})
    return fs.read_masked(data.spark, path, filled=True)


@query("SELECT vec_id, embedding FROM embeddings WHERE vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 40)")
def product_dereference(data):
    path = f"{data.root}/embeddings.parquet"
    rows = data.vectors[["vec_id"]].to_df().orderBy("vec_id").limit(40)
    held = fs.locators(rows, path, 0, F.col("vec_id"), "embedding").select("vec_id", "locator.*").drop("column")
    return fs.products(held, fs.parquet_products("embedding", "vec_id")).select("vec_id", F.transform("value", lambda v: v.cast("float")).alias("embedding"))


@query("SELECT 'o_orderkey' AS k, CAST(count(*) AS VARCHAR) AS header FROM orders")
def product_headers(data):
    def read(path: str, extn: int) -> dict:
        import pyarrow.parquet as pq

        return {"rows": pq.ParquetFile(path).metadata.num_rows}

    place = data.spark.createDataFrame([(f"{data.root}/orders.parquet", 0)], "path string, extn int")
    return fs.headers(place, read, "rows").select(F.lit("o_orderkey").alias("k"), "header")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' END AS state, CASE WHEN o_orderpriority = '1-URGENT' THEN 'high' WHEN regexp_full_match(o_orderpriority, '[2-3].*') THEN 'middle' END AS kind, [1.0, 1.5, 2.0] AS grid FROM orders")
def decoders(data):
    state = fs.decode(F.col("o_orderstatus"), [{"O": "open", "F": "filled"}])[0]
    kind = fs.file_kind(F.col("o_orderpriority"), {"high": "1-URGENT", "middle": "[2-3].*"})
    return data.frame("Order").select("o_orderkey", state.alias("state"), kind.alias("kind"), fs.grid(F.lit(1.0), F.lit(0.5), F.lit(3)).alias("grid"))


def _orders_and_customers(spark: SparkSession, steps: DataFrame) -> dict[str, DataFrame]:
    """One file gives orders, customers and the edges between them, an interval of rows at a time."""
    path = steps.first()["path"]
    rows = spark.read.parquet(path).withColumn("_at", F.col("o_orderkey"))
    part = rows.join(F.broadcast(steps.select("start", "end")), (F.col("_at") >= F.col("start")) & (F.col("_at") <= F.col("end")), "left_semi")
    return {"Order": part.select("o_orderkey", "o_totalprice"), "Customer": part.select("o_custkey").distinct(), "ordered": part.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))}


def _length(files: DataFrame) -> DataFrame:
    spark = files.sparkSession
    path = files.first()["path"]
    return files.crossJoin(F.broadcast(spark.read.parquet(path).agg((F.max("o_orderkey") + 1).alias("n")))).select("fname", "n")


def _ingested(data, broken_after: int | None = None) -> Store:
    """A store that reads the orders in intervals; broken off after some of them and opened again."""
    files = fs.discover(data.spark, data.root, r"orders\.parquet")
    total = data.frame("Order").agg(F.max("o_orderkey")).first()[0] + 1
    identity = {"Order": ("o_orderkey",), "Customer": ("o_custkey",), "ordered": ("src", "dst")}
    calls = []

    def read(spark: SparkSession, steps: DataFrame) -> dict[str, DataFrame]:
        calls.append(1)
        if broken_after is not None and len(calls) > broken_after:
            raise OSError("broken off")
        return _orders_and_customers(spark, steps)

    store = Store(data.spark)
    make = lambda f: Reader("orders", f, identity, size=-(-total // 3), length=_length)
    if broken_after is not None:
        try:
            store.write(files, [make(read)], at_once=1)
        except OSError:
            store = Store(data.spark, store.root)  # what had been done is known
    store.write(files, [make(_orders_and_customers)], at_once=1)
    return store


@query("SELECT o_custkey AS src, o_orderkey AS dst, o_totalprice FROM orders")
def ingest_entities(data):
    store = _ingested(data)
    return store.frames["ordered"].select("src", "dst").join(store.frames["Order"].select(F.col("o_orderkey").alias("dst"), "o_totalprice"), "dst").join(store.frames["Customer"].select(F.col("o_custkey").alias("src")), "src", "left_semi")


@query("SELECT 'orders' AS reader, 'orders.parquet' AS fname, CAST(i AS BIGINT) AS commit, CAST(i * s - s AS BIGINT) AS \"start\", CAST(least(i * s, n) - 1 AS BIGINT) AS \"end\" FROM (SELECT max(o_orderkey) + 1 AS n, CAST(ceil((max(o_orderkey) + 1) / 3) AS BIGINT) AS s FROM orders), unnest([1, 2, 3]) t(i)")
def ingest_resumed_manifest(data):
    return _ingested(data, broken_after=1).manifest.select("reader", "fname", "commit", "start", "end")
