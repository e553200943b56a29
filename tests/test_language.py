"""Names, paths, plurality, errors, results and the laws of the query language."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery import functions as fn
from orrery.demo import registry
from orrery.errors import AmbiguousPathError, AttributeNameError, CardinalityError, DisjointPathError, SchemaError
from orrery.naming import plural, similarity, snake, suggest
from orrery.operators.combine import align, join, split
from orrery.operators.results import rectangular
from orrery.plans.paths import find_paths
from orrery.plans.schema import Entity, Registry, Relation, measures


def toy():
    r = Registry().add(
        Entity("Animal", attributes=("legs",), template=True), Entity("Owner", identity=("oid",), attributes=("oid",)),
        Entity("Cat", identity=("cid",), attributes=("cid", "owner", "legs", "shared"), is_a="Animal"), Entity("Dog", identity=("did",), attributes=("did", "owner", "legs"), is_a="Animal"),
        Entity("Toy", identity=("tid",), attributes=("tid", "cat", "shared")), Entity("Bike", identity=("bid",), attributes=("bid", "owner")),
    )
    return r.relate(Relation("Owner", "Animal", ("owner",)), Relation("Cat", "Toy", ("cat",)), Relation("Owner", "Bike", ("owner",)))


def test_names():
    assert snake("L1SingleSpectrum") == "l1_single_spectrum"
    assert [plural(x) for x in ("party", "key", "box", "order", "a.city")] == ["parties", "keys", "boxes", "orders", "a.cities"]
    assert similarity("custmer", "customer") > similarity("custmer", "order")
    assert suggest("custmers", ["customers", "orders", "parts"])[0] == "customers"


@given(st.text(max_size=12), st.text(max_size=12))
def test_similarity_is_bounded(a, b):
    assert 0 <= similarity(a, b) <= 1 + 1e-9


def test_paths():
    r = toy()
    assert [h.target for h in find_paths(r, "Toy", "Owner", singular=True)[0]] == ["Cat", "Owner"] or [h.target for h in find_paths(r, "Toy", "Owner")[0]][-1] == "Owner"
    with pytest.raises(CardinalityError):
        find_paths(r, "Owner", "Toy", singular=True)
    with pytest.raises(DisjointPathError):
        find_paths(r, "Bike", "Toy")
    demo = registry()
    assert [h.target for h in find_paths(demo, "Lineitem", "Nation", singular=True)[0]] == ["Supplier", "Nation"]
    assert {p[-1].target for p in find_paths(demo, "Nation", "Party")} <= {"Party", "Customer", "Supplier"}


def test_schema_errors():
    with pytest.raises(SchemaError):
        Registry().add(Entity("Thing", identity=("x",), attributes=("y",)))
    with pytest.raises(SchemaError):
        Registry().add(Entity("Thing"))
    with pytest.raises(SchemaError):
        Registry().add(Entity("lower", identity=("x",), attributes=("x",)))
    with pytest.raises(SchemaError):
        toy().relate(Relation("Owner", "Ghost", ("x",)))
    assert measures("mag", prefix="t_") == ("t_mag", "t_mag_error")
    older = toy()
    assert toy().compatible(older) == []
    assert any("optional" in x for x in toy().relate(Relation("Owner", "Toy", ("tid",))).compatible(older))


def test_resolution_errors(data):
    with pytest.raises(CardinalityError):
        data.customer
    with pytest.raises(AttributeNameError, match="customers"):
        data.custmers
    with pytest.raises(CardinalityError):
        data.customers.order
    with pytest.raises(CardinalityError):
        data.orders.customers
    with pytest.raises(TypeError):
        data.customers[data.customers.c_custkey]
    with pytest.raises(TypeError):
        data.customers.c_name > 3
    with pytest.raises(TypeError):
        data.vectors.embedding + 1
    with pytest.raises(TypeError):
        data.customers + 1
    with pytest.raises(DisjointPathError):
        fn.count(data.customers.orders, wrt=data.parts)
    with pytest.raises(DisjointPathError):
        data.customers[data.parts.p_size > 3].to_df()
    with pytest.raises(TypeError):
        bool(data.customers.c_custkey == 1)
    with pytest.raises((AmbiguousPathError, AttributeNameError)):
        data.nothing_like_it


def test_wrt_is_found_by_value(data):
    c = data.customers
    first = c[["c_custkey", {"n": fn.count(c.orders, wrt=c)}]].to_df()
    again = data.customers[["c_custkey", {"n": fn.count(data.customers.orders, wrt=data.customers)}]].to_df()
    assert sorted(first.collect()) == sorted(again.collect())


def test_counts_add_up(data):
    c = data.customers
    total = fn.sum(fn.count(c.orders, wrt=c))()
    assert total == fn.count(data.orders)() == data.orders.o_orderkey.to_df().count()


def test_split_is_the_whole(data):
    s = split(data.customers, "c_mktsegment").then(lambda c: c[["c_custkey", {"n": fn.count(c.orders, wrt=c)}]])
    parts = [r for _, q in s for r in q.to_df().collect()]
    whole = data.customers[["c_custkey", {"n": fn.count(data.customers.orders, wrt=data.customers)}]].to_df().collect()
    assert sorted(parts) == sorted(whole)


def test_align_equals_separate(data):
    c = data.customers
    o = c.orders
    pair = align(f=o[o.o_orderstatus == "F"], o=o[o.o_orderstatus == "O"])
    sums = pair.o_totalprice.apply(lambda x: fn.sum(x, wrt=c)).table(c).to_df()
    apart = c[[{"f_sum": fn.sum(o[o.o_orderstatus == "F"].o_totalprice, wrt=c)}, {"o_sum": fn.sum(o[o.o_orderstatus == "O"].o_totalprice, wrt=c)}]].to_df()
    assert sums.columns == apart.columns
    assert sorted(sums.collect()) == sorted(apart.collect())


def test_results(data):
    with pytest.warns(UserWarning, match="limit"):
        assert len(data.orders.o_orderkey(limit=5)) == 5
    assert data.regions.r_name(limit=None).shape == (5,)
    assert isinstance(fn.max(data.orders.o_totalprice)(), float)
    assert data.regions[["r_regionkey", "r_name"]](limit=1)["r_regionkey"] == 0
    assert sum(1 for _ in data.nations.n_name) == 25
    m = rectangular(data.conversations[[{"roles": data.conversations.turns.turn}]].to_df().toPandas()["roles"])
    assert m.ndim == 2


def test_plain_iterables():
    assert fn.sum([1, 2]) == 3 and fn.max([1, 5]) == 5 and fn.any([0, 1]) and not fn.all([0, 1])
    assert fn.count([1, 1], distinct=True) == 1 and fn.mean([1, 3]) == 2 and fn.std([1]) == 0
    assert fn.sqrt(-1) is None and fn.log(0) is None and fn.floor(1.5) == 1


def test_upload_errors(data):
    import pandas as pd

    with pytest.raises(ValueError):
        join(pd.DataFrame({"k": [1]}), ["k"], data.customers, [data.customers.c_custkey, data.customers.c_name])
    wide = pd.DataFrame({"k": [1], "w": [list(range(200))]})
    with pytest.warns(UserWarning, match="wide"):
        rows, c = join(wide, "k", data.customers, data.customers.c_custkey)
    with pytest.raises(KeyError):
        rows["w"]


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 50), st.integers(0, 50))
def test_masks_compose(data, a, b):
    p = data.parts
    twice = p[p.p_size > a]
    twice = twice[twice.p_size < b]
    once = p[(p.p_size > a) & (p.p_size < b)]
    assert twice.p_partkey.to_df().count() == once.p_partkey.to_df().count()


def test_plans_prune_and_push(data):
    c = data.customers
    plan = c[c.c_acctbal > 0][["c_custkey", {"n": fn.count(c.orders, wrt=c)}]].to_df()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(c_acctbal" in text
    assert "o_totalprice" not in text and "c_mktsegment" not in text


def test_discovery(data):
    from orrery.operators.discover import attributes, explain, find, match, match_edges, objects, without

    assert find(data, "custmer")[0] == "customer" and "c_name" in find(data.customers, "c_nam")
    assert attributes(data.nations, own=True) == ["n_name", "n_nationkey", "n_regionkey"]
    assert "r_name" in attributes(data.nations, many=False) and "c_names" in attributes(data.nations, many=True)
    assert {"customer", "nation", "region"} <= set(objects(data.orders, many=False))
    assert "lineitems" in objects(data.orders, many=True)
    assert "Nation" in explain(data.parties) and "identity" in explain(data.orders)
    df = data.spark.createDataFrame([(1, None), (2, "x")], "src int, v string")
    assert match(df, v=None).first()["src"] == 1 and match_edges(df, src=2).count() == 1
    assert without(df, df.where("src = 1"), "src").first()["src"] == 2
    assert data.registry.frame(data.spark).where("kind = 'relation'").count() == len(data.registry.relations)


def test_existence_filters_are_semi_joins(data):
    c = data.customers
    for mask, how in ((fn.exists(c.events, wrt=c), "LeftSemi"), (~fn.exists(c.events, wrt=c), "LeftAnti")):
        plan = c[mask].c_custkey.to_df()._jdf.queryExecution().optimizedPlan().toString()
        assert how in plan and "Aggregate" not in plan
