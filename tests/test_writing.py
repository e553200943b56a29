"""Laws of upserts, versions, manifests, files and the validator."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.demo import open_dataset
from orrery.errors import CollisionError, NullPropertyError, PropertyOverlapError
from orrery.operators import upsert as up
from orrery.operators import validate as check
from orrery.sources import files as fs
from orrery.sources.dataset import normalise_missing
from orrery.sources.ingest import Reader, Store, in_order

ROWS = st.lists(st.tuples(st.integers(0, 4), st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.text("ab", max_size=2))), max_size=6)
KIND = "k int, a int, b string"


def table(df):
    return {r["k"]: (r["a"], r["b"]) for r in df.collect()}


def fold(rows, last=False):
    """Written one after the other: known values stay, or are replaced by later ones."""
    key = lambda r: [(x is not None, x if x is not None else 0) for x in r[1:]]
    out = {}
    for k, *new in sorted(rows, key=key):
        old = out.get(k, (None, None))
        out[k] = tuple((o if n is None else n) if last else (n if o is None else o) for o, n in zip(old, new, strict=True))
    return out


@settings(max_examples=12, deadline=None)
@given(ROWS, ROWS)
def test_upsert_laws(spark, old, new):
    stored = fold(old)
    t, s = spark.createDataFrame([(k, *v) for k, v in stored.items()], KIND), spark.createDataFrame(new, KIND)
    kept, taken = table(up.upsert(t, s, ["k"], "ignore", 1)[0]), table(up.upsert(t, s, ["k"], "overwrite", 1)[0])
    first, last = fold(new), fold(new, last=True)
    assert set(kept) == set(taken) == set(stored) | set(first)
    for k in kept:
        for i in (0, 1):
            a, x, y = (f.get(k, (None, None))[i] for f in (stored, first, last))
            assert kept[k][i] == (x if a is None else a)
            assert taken[k][i] == (a if y is None else y)
    merged, _ = up.upsert(t, s, ["k"], "overwrite", 1)
    assert table(up.upsert(merged, s, ["k"], "overwrite", 2)[0]) == taken  # again is the same


def test_rows_of_one_identity_stay_whole(spark):
    none = spark.createDataFrame([], "k int, name string, v int")
    twice = spark.createDataFrame([(1, "b", 1), (1, "a", 9), (2, "c", None), (2, None, 4), (2, "d", 5)], "k int, name string, v int")
    pick = lambda policy, **o: {r["k"]: (r["name"], r["v"]) for r in up.upsert(none, twice, ["k"], policy, 1, **o)[0].collect()}
    assert pick("ignore") == {1: ("a", 9), 2: ("c", 4)} and pick("overwrite") == {1: ("b", 1), 2: ("d", 5)}
    assert pick("ignore", order=["v"])[1] == ("b", 1)
    rejected = up.upsert(none, twice, ["k"], "track", 1)[1].collect()
    assert {(r["k"], r["column"], r["old"], r["new"]) for r in rejected} == {(1, "name", "a", "b"), (1, "v", "9", "1"), (2, "name", "c", None), (2, "name", "c", "d"), (2, "v", "4", None), (2, "v", "4", "5")}


def test_identity_only_and_missing_identities(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (None, 3), (4, 5)], "src int, dst int")
    assert sorted((r["src"], r["dst"]) for r in up.upsert_edges(edges.limit(0), edges, now=1)[0].collect()) == [(1, 2), (4, 5)]
    with pytest.raises(NullPropertyError):
        up.upsert(edges.limit(0), edges, ["src", "dst"])
    nan = spark.createDataFrame([(math.nan, 1), (1.0, 2)], "k double, v int")
    assert [r["k"] for r in up.upsert(nan.limit(0), nan, ["k"], missing="drop")[0].collect()] == [1.0]


def test_dependent_parents_keep_their_kind(spark):
    rows = spark.createDataFrame([(1, 2, "x"), (2, 1, "y"), (2, 1, "z")], "run int, fibre int, v string")
    got = up.merge_dependent(rows.limit(0), rows, [], ["run", "fibre"], now=1)[0]
    assert sorted((r["run"], r["fibre"], r["v"]) for r in got.collect()) == [(1, 2, "x"), (2, 1, "y")]
    within = up.merge_dependent(rows.limit(0), rows, [], {"end": ["run", "fibre"]}, now=1)[0]
    assert within.count() == 1
    none = spark.createDataFrame([], "src string, dst struct<v:string>, kind string")
    by_node, edges = up.merge_object(rows.select("v").limit(0), none, rows, ["v"], ["run"], strategy="node", now=1)
    assert by_node.count() == 3 and sorted((r["src"], r["dst"]["v"], r["kind"]) for r in edges.collect()) == [("1", "x", "run"), ("2", "y", "run"), ("2", "z", "run")]


def test_ordered_and_optional_edges(spark):
    df = spark.createDataFrame([(1, [7, None, 8]), (2, [])], "k int, xs array<int>")
    assert sorted(tuple(r) for r in up.ordered_edges(df, "k", "xs").collect()) == [(1, 7, 0), (1, 8, 2)]
    pairs, none = spark.createDataFrame([(1, 2), (3, None)], "a int, b int"), spark.createDataFrame([], "src int, dst int")
    assert sorted((r["src"], r["dst"]) for r in up.attach(none, pairs, "a", "b", mirrored=True, now=1).collect()) == [(1, 2), (2, 1)]


def test_upsert_errors_and_tracking(spark):
    t, s = spark.createDataFrame([(1, 2, "x")], KIND), spark.createDataFrame([(1, 3, None), (2, 1, "n")], KIND)
    with pytest.raises(CollisionError):
        up.upsert(t, s, ["k"], "other")
    merged, rejected = up.upsert(t, s, ["k"], "track", 5)
    assert table(merged) == {1: (2, "x"), 2: (1, "n")}
    assert {(r["column"], r["old"], r["new"]) for r in rejected.collect()} == {("a", "2", "3"), ("b", "x", None)}
    assert {r["_dbcreated"] for r in merged.collect()} == {5}
    assert up.restore(merged, 4).count() == 0
    with pytest.raises(PropertyOverlapError):
        up.check_keys(s, ["k"], ["k", "a"])
    with pytest.raises(NullPropertyError):
        up.check_keys(spark.createDataFrame([(None, 1)], "k int, a int"), ["k"])
    with pytest.raises(NotImplementedError):
        up.merge_dependent(t, s, ["k"], policy="track")
    assert up.violations(t, s, ["k"]).count() == 2


def test_edges_and_relational_keys(spark):
    kind = "src int, dst int, w int"
    merged, _ = up.upsert_edges(spark.createDataFrame([(1, 2, 3)], kind), spark.createDataFrame([(1, 2, 4), (None, 2, 1), (2, 3, 1)], kind), now=1)
    assert sorted((r["src"], r["dst"], r["w"]) for r in merged.collect()) == [(1, 2, 3), (2, 3, 1)]
    rows = spark.createDataFrame([(None, 2), (2, None), (2, None)], "a int, b int")
    assert up.merge_dependent(rows.limit(0), rows, ["a", "b"], now=1)[0].count() == 2


def test_versions_and_intervals(spark):
    rows = spark.createDataFrame([("p", 1, 4), ("p", 2, None), ("p", 3, None), ("q", 1, None)], "p string, o int, version int")
    got = {(r["p"], r["o"]): r["version"] for r in up.set_version(rows, ["p"], ["o"]).collect()}
    assert got == {("p", 1): 4, ("p", 2): 5, ("p", 3): 6, ("q", 1): 0}
    done = up.intervals(spark.createDataFrame([("f", i) for i in (0, 1, 2, 5, 6, 9, 9)], "fname string, i int"), ["fname"], "i")
    assert sorted((r["start"], r["end"]) for r in done.collect()) == [(0, 2), (5, 6), (9, 9)]
    wanted = spark.createDataFrame([("f", 0, 1), ("f", 2, 5), ("g", 0, 1)], "fname string, start int, end int")
    assert sorted((r["fname"], r["start"]) for r in up.covered(done, wanted, ["fname"]).collect()) == [("f", 2), ("g", 0)]


def test_rows_and_lists(spark):
    df = spark.createDataFrame([(1, [1, 2], ["a"])], "k int, x array<int>, y array<string>")
    assert sorted((r["i"], r["x"], r["y"]) for r in up.unwind(df, "x", "y", index="i").collect()) == [(0, 1, "a"), (1, 2, None)]
    flat = spark.createDataFrame([(1, "a", 2), (1, "b", 3), (1, "b", 3)], "k int, n string, v int")
    assert up.group_map(flat, ["k"], "n", "v").first()["map"] == {"a": 2, "b": 3}
    assert up.collect_rows(flat, ["k"], "v").first()["v"] == [2, 3, 3]
    assert up.union_lists(df.unionByName(df), ["k"], "x").first()["x"] == [1, 2]


def test_missing_values(spark):
    df = normalise_missing(spark.createDataFrame([(math.nan, "<MISSING>"), (math.inf, "x"), (-math.inf, None), (1.0, "y")], "a double, b string"))
    assert sorted([tuple(r) for r in df.collect()], key=repr) == sorted([(None, None), (None, "x"), (None, None), (1.0, "y")], key=repr)


def test_validator(spark, sf):
    data = open_dataset(spark, sf)
    found = {(r["check"], r["name"]): r["offending"] for r in check.report(data).collect()}
    assert found["identity", "Customer"] == 0 and found["relation", "Order -> Customer"] == 0
    assert found["reflected", "Label -> Document"] == 0 and found["order", "Turn -> Conversation"] == 0 and found["duplicate edges", "Event -> Event (next_event)"] == 0
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "fname string")
    assert check.report(data, names("f", "g"), names("f")).where("check = 'absent files'").first()["offending"] == 1
    objects, files = spark.createDataFrame([(1, 5), (2, 6)], "k int, _dbcreated int"), spark.createDataFrame([("f", 5)], "fname string, _dbcreated int")
    assert [r["k"] for r in check.without_file(objects, files).collect()] == [2]
    assert check.absent_files(spark.createDataFrame([("f",), ("g",)], "fname string"), files).first()["fname"] == "g"


def test_files_and_ingest(spark, tmp_path):
    for n, rows in (("a1.csv", "k,v\n1,x\n2,y\n"), ("a2.csv", "k,v\n2,z\n3,w\n"), ("b.txt", "k v\n1 2\n")):
        (tmp_path / n).write_text(rows)
    found = fs.discover(spark, str(tmp_path), r".*\.csv", r"a9.*")
    assert sorted(r["fname"] for r in found.collect()) == ["a1.csv", "a2.csv"]
    assert fs.text_table(spark, str(tmp_path / "b.txt")).first()["v"] == 2
    reader = Reader("Thing", lambda s, paths: s.read.csv(paths, header=True, schema="k int, v string"), ("k",), r"a.*")
    store = Store(spark)
    stats = store.write(found.where("fname = 'a1.csv'"), [reader], policy="track").first()
    assert (stats["files"], stats["rows"]) == (1, 2)
    store.write(found, [reader], policy="track")
    assert {r["k"]: r["v"] for r in store.frames["Thing"].collect()} == {1: "x", 2: "y", 3: "w"}
    assert [(r["k"], r["new"]) for r in store.collisions["Thing"].collect()] == [(2, "z")]
    assert store.complete().count() == 2
    assert store.write(found, [reader], policy="track").first()["files"] == 0
    assert store.write(found, [reader], skip_complete=False, dryrun=True).first()["files"] == 2
    assert [r.entity for r in in_order([Reader("B", None, (), after=("A",)), Reader("A", None, ())])] == ["A", "B"]
    steps = fs.batches(spark.createDataFrame([("f", 120)], "fname string, n int"), "n", 50, ["p", "q"]).collect()
    assert sorted({(r["start"], r["end"]) for r in steps}) == [(0, 49), (50, 99), (100, 119)] and len(steps) == 6


def test_products_and_decoders(spark, sf):
    from pyspark.sql import functions as F

    located = spark.createDataFrame([(f"{sf}/embeddings.parquet", 0, 3), (f"{sf}/embeddings.parquet", 0, 1)], "path string, extn int, index int")
    out = {r["index"]: r["value"] for r in fs.products(located, fs.parquet_products("embedding", "vec_id")).collect()}
    want = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id in (1, 3)").collect()}
    assert all(abs(a - b) < 1e-6 for k in (1, 3) for a, b in zip(out[k], want[k], strict=True))
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(fs.decode(F.lit("AB"), [{"A": 1}, {"B": 2}]))], fs.grid(F.lit(1.0), F.lit(0.5), F.lit(3)).alias("g"), fs.highest(["single", "stack"], F.array(F.lit("stack"), F.lit("single"))).alias("h"), fs.file_kind(F.lit("r1.fit"), {"raw": r"r\d+\.fit"}).alias("k")).first()
    assert (row["c0"], row["c1"], row["g"], row["h"], row["k"]) == (1, 2, [1.0, 1.5, 2.0], "stack", "raw")


def test_stream_replays(spark, tmp_path):
    from orrery.streaming import upsert_stream
    from orrery.streaming.incremental import current

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(src)
    read = lambda: spark.readStream.schema("k int, v string").parquet(src)
    upsert_stream(read(), out, ["k"], str(tmp_path / "cp")).awaitTermination(60)
    spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string").write.mode("append").parquet(src)
    upsert_stream(read(), out, ["k"], str(tmp_path / "cp")).awaitTermination(60)
    assert {r["k"]: r["v"] for r in current(spark, out).collect()} == {1: "a", 2: "c", 3: "d"}


def test_store_of_several_entities(spark, tmp_path):
    """One file gives entities and edges, an interval at a time; a second reader sees it too, and a store goes on where it broke off."""
    from pyspark.sql import functions as F

    (tmp_path / "run.csv").write_text("k,parent,v\n" + "".join(f"{i},{i % 3},{i * 10}\n" for i in range(10)))
    files = fs.discover(spark, str(tmp_path), r".*\.csv")
    calls = []

    def read(s, steps):
        calls.append(sorted((r["start"], r["end"]) for r in steps.collect()))
        if len(calls) == 2:
            raise OSError("broken off")
        rows = s.read.csv(steps.first()["path"], header=True, schema="k int, parent int, v int")
        rows = rows.join(steps.select("start", "end"), F.col("k").between(F.col("start"), F.col("end")), "left_semi")
        return {"Child": rows.select("k", "v"), "Parent": rows.select("parent").distinct(), "link": rows.select(F.col("parent").alias("src"), F.col("k").alias("dst"))}

    identity = {"Child": ("k",), "Parent": ("parent",), "link": ("src", "dst")}
    reader = Reader("runs", read, identity, size=4, length=lambda f: f.select("fname", F.lit(10).alias("n")))
    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(OSError):
        store.write(files, [reader], at_once=1)
    again = Store(spark, str(tmp_path / "store"))
    assert again.frames["Child"].count() == 4
    stats = again.write(files, [reader], at_once=1).first()
    assert stats["rows"] == 6 + 3 + 2 + 6  # children, parents of each interval, links
    assert again.frames["Child"].count() == 10 and again.frames["Parent"].count() == 3 and again.frames["link"].count() == 10
    assert calls == [[(0, 3)], [(4, 7)], [(4, 7)], [(8, 9)]]
    other = Reader("Other", lambda s, paths: s.read.csv(paths, header=True, schema="k int, parent int, v int").select("k"), ("k",))
    assert again.write(files, [other]).first()["files"] == 1  # a file is new to every reader
    assert again.write(files, [other, reader]).agg(F.sum("files")).first()[0] == 0
    at = again.frames["Child"].agg(F.min("_dbcreated")).first()[0]
    again.restore_state(at)
    assert Store(spark, str(tmp_path / "store")).frames["Child"].count() == 4
    with pytest.raises(Exception, match="same name"):
        again.write(files.unionByName(files), [other])


def test_fused_aggregates_take_one_grouping(data):
    from orrery import functions as fn

    c = data.customers
    p = c.orders.o_totalprice
    df = c[["c_custkey", {"lo": fn.min(p, wrt=c)}, {"hi": fn.max(p, wrt=c)}, {"mean": fn.mean(p, wrt=c)}, {"n": fn.count(c.orders, wrt=c)}]].to_df()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("Exchange hashpartitioning") <= 1
    mixed = c[["c_custkey", {"r": fn.sum(p / c.c_acctbal, wrt=c)}]].to_df()  # needs the parent's column
    assert mixed.count() == data.customers.c_custkey.to_df().count()


def test_unknown_columns_and_wide_lists(data, monkeypatch):
    from orrery.errors import AttributeNameError, DisjointPathError
    from orrery.operators import tables

    t = data.customers[["c_custkey", "c_name"]]
    with pytest.raises(AttributeNameError, match="c_name"):
        t["c_nam"]
    assert data.customers[["c_custkey", "c_custkey", {"c_custkey0": "c_name"}]].names() == ["c_custkey1", "c_custkey2", "c_custkey0"]
    monkeypatch.setattr(tables, "WIDEST_LIST", 5)
    with pytest.raises(DisjointPathError):
        data.regions[["r_name", {"all": data.nations.n_name}]].to_df()
