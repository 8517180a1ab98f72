from collections import Counter

import pytest

import corpus_pipeline
from gridloom.llm import mixing
from tests.llm.cases import documents, prose
from tests.llm.test_pairs import linked_components

DATA = "/root/testdata/sf0.001"


def tables(spark, tmp_path):
    """A small corpus with planted copies, passages and toxic texts, and the same with none of them marked."""
    rows = [(i, prose(i, 60), f"s{i % 3}") for i in range(60)]
    items = [(k, prose(f"bench{k}", 25)) for k in range(5)]
    rows += [(100 + k, prose(f"a{k}", 30) + " " + t + " " + prose(f"b{k}", 30), "s0") for k, t in items]
    rows += [(200 + i, rows[i][1], "s1") for i in range(10)] + [(220 + i, rows[i][1] + " " + prose(f"c{i}", 2), "s2") for i in range(5)]
    rows += [(300 + i, prose(f"t{i}", 40) + " vile scum moron", "s1") for i in range(80)] + [(7, rows[7][1], "s1"), (None, prose("n", 20), "s0"), (400, None, "s2"), (401, "", "s2")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(300 + i, 0, 1) for i in range(60)] + [(i, 1, 0) for i in range(60)] + [(1000 + i, 1, 0) for i in range(400)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    rows = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    ids = lambda df: Counter(r["doc_id"] for r in df.collect())
    kept = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, given = ids(kept), kept
        kept = stage(spark, given, str(tmp_path))
        if k < 3:
            kept.write.parquet(f"{tmp_path}/{k}")
            kept = spark.read.parquet(f"{tmp_path}/{k}")
            assert sorted(kept.columns) == sorted(names)
        after = ids(kept)
        assert not after - before
        text = {i: t for i, t, _ in rows}
        if name == "toxicity":
            assert not [i for i in after if i is not None and 300 <= i < 380]
            assert before - after == Counter(range(300, 380))
        elif name == "near copies":
            want = linked_components([(i, text[i], "") for i in before if i is not None], 5, 80, 100)
            assert after == Counter({i for i in before if i is None or want[i] == i})
        elif name == "decontamination":
            assert before - after == Counter(range(100, 105))
        else:
            mixed = {r["doc_id"]: r["taken"] for r in kept.collect()}
            assert mixed == {r["doc_id"]: r["taken"] for r in mixing.mix(given).collect() if r["taken"]}
            assert after


def test_run_and_empty_tables(spark, tmp_path):
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == ["doc_id", "source", "size", "source_size", "target", "taken"]
    assert 0 < got.count() <= spark.read.parquet(f"{DATA}/documents.parquet").count()
    rows = tables(spark, tmp_path)
    assert rows
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("most", [corpus_pipeline.BROADCAST_BYTES, 0])
def test_near_copies_leave_without_a_shuffle_of_texts(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_BYTES", most)
    rows = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "text as _pack", "doc_id as _ids")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a table too large for the setting
    try:
        for repeats in (True, False):  # doc_id 7 has two rows
            given = docs if repeats else docs.filter("doc_id is null or doc_id <> 7")
            kept = corpus_pipeline.drop_near_copies(spark, given, str(tmp_path))
            plan = kept._jdf.queryExecution().executedPlan().toString()
            assert ("SortMergeJoin" in plan) == (most == 0), plan
            assert kept.columns == docs.columns
            want = linked_components([r for r in rows if r[0] is not None and (repeats or r[0] != 7)], 5, 80, 100)
            assert any(want[i] != i for i in want)
            assert Counter(r["doc_id"] for r in kept.collect()) == Counter([*(i for i in want if want[i] == i), None])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
