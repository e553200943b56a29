import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from orrery.llm import mixing
from orrery.llm import queries as llm


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "mixing", "packing"]
    assert {"pipeline", "op1_toxicity", "op10_ngram_join"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("i", range(5))
def test_stages_keep_columns_and_survive_nothing(spark, docs, sf, i):
    name, stage = corpus_pipeline.STAGES[i]
    out = stage(spark, docs.limit(0), sf)
    assert out.count() == 0
    assert out.columns == docs.columns if i < 4 else {"doc_id", "start", "sequence_id", "offset", "ids"} <= set(out.columns)


CLASHES = ("body", "_body", "kept_id", "_kept_id", "kept_sha", "mix_place", "mix_source", "mix_copies", "mix_copy", "place", "copies", "Body_1")


@pytest.mark.parametrize("i", range(5))
def test_stages_on_odd_rows(spark, odd, sf, i):
    """Nulls, repeats, empty and long texts, and columns that are called like those inside the stages."""
    name, stage = corpus_pipeline.STAGES[i]
    wide = odd.withColumns({c: F.lit(c) for c in CLASHES})
    got = stage(spark, wide, sf)
    if name == "packing":
        want = {(r["doc_id"], r["text"]) for r in odd.collect()}
        starts = [r["doc_id"] for r in got.where("start = 0").collect()]
        assert sorted(starts, key=repr) == sorted((r["doc_id"] for r in odd.collect()), key=repr) and want
        return
    assert got.columns == wide.columns
    rows, had = [tuple(r) for r in got.collect()], Counter(tuple(r) for r in wide.collect())
    assert set(rows) <= set(had)
    ids = Counter(r[0] for r in rows)
    if name == "toxicity":
        assert Counter(rows) == had
    elif name == "exact_dedup":
        assert ids == Counter({13: 1, 3: 1, 6: 1, 5: 1, 8: 1, 9: 1, 10: 1, 11: 1, 12: 1, 14: 1, 15: 1})
    elif name == "ngram_join":
        assert ids[1] == 1 and ids[2] == ids[13] == ids[3] == 0 and ids[7] == 2 and ids[8] == 0
        assert all(ids[k] == 1 for k in (4, 5, 6, 9, 10, 11, 12, 14, 15))
    else:
        plan = mixing.mix_rows(wide).select("doc_id", "copies").collect()
        want = Counter()
        for r in plan:
            want[r["doc_id"]] += r["copies"]
        assert ids == +want


def test_pipeline_steps(spark, docs, sf):
    at = {}
    df = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        df = stage(spark, df, sf)
        rows = df.collect()
        df = spark.createDataFrame(rows, docs.schema)
        at[name] = rows
    whole = {r["doc_id"]: tuple(r) for r in docs.collect()}
    assert all(tuple(r) == whole[r["doc_id"]] for rows in at.values() for r in rows)
    ids = {k: {r["doc_id"] for r in rows} for k, rows in at.items()}
    assert ids["ngram_join"] <= ids["exact_dedup"] <= ids["toxicity"]
    texts = [r["text"].lower() for r in at["exact_dedup"]]
    assert len(set(texts)) == len(texts)


def test_queries_give_whole_results(spark, docs, sf):
    got = llm.op8_token_files(spark, sf)
    assert got.count() == docs.count()
    held = {r["doc_id"]: r["held_out"] for r in llm.op7_language_id(spark, sf).collect()}
    assert held == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in held} and len(held) == docs.count()
    sizes = llm.op2_packing(spark, sf).groupBy("sequence_id").sum("length").collect()
    assert np.mean([r[1] for r in sizes]) > 0.9 * 4096
