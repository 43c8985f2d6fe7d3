import inspect

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from conftest import SF
from ledgerlens.llm import decontam, quality
from ledgerlens.llm.common import table, written
from tests.llm.helpers import DOC, empty_documents
from tests.llm.test_decontam import plain_leaks
from tests.llm.test_packing import check_places
from tests.llm.test_simhash import plain_components, plain_fingerprint


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for _, stage in cp.STAGES:
        out.append((docs, result := written(stage(spark, docs, SF))))
        docs = result
    return out


def test_names_and_signatures():
    assert len(cp.STAGES) == 5 and all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in cp.STAGES)


def test_columns_and_rows_only_go(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns
        assert after.count() <= before.count() and after.exceptAll(before).count() == 0


def test_quality(spark):
    """On a table with enough labels; those of junk and toxic documents go, clean ones stay."""
    sf = SF.replace("sf0.001", "sf0.1")
    labels = table(spark, sf, "labels").withColumn("clean", F.expr("quality = 1 AND toxic = 0"))
    kept = cp.good_documents(spark, table(spark, sf, "documents"), sf)
    rate = {r["clean"]: r["n"] for r in kept.join(labels, "doc_id").groupBy("clean").agg(F.count("*").alias("n")).collect()}
    total = {r["clean"]: r["n"] for r in labels.groupBy("clean").agg(F.count("*").alias("n")).collect()}
    assert rate[True] >= 0.98 * total[True] and rate.get(False, 0) <= 0.2 * total[False]


def test_language(stages):
    before, after = stages[1]
    assert after.count() >= 0.98 * before.count()


def test_one_of_each_group(stages):
    before, after = stages[2]
    rows = before.select("doc_id", "text").collect()
    groups = plain_components([plain_fingerprint(r["text"], 4) for r in rows], [r["doc_id"] for r in rows], 4)
    assert sorted(r["doc_id"] for r in after.select("doc_id").collect()) == sorted(set(groups))


def test_leaks(spark, stages):
    before, after = stages[3]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    leaking = plain_leaks([(r["doc_id"], r["text"]) for r in before.collect()], items)
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - {i for i, _ in leaking}
    assert leaking


def test_packing(stages):
    before, after = stages[4]
    rows = after.collect()
    check_places(rows, 2048)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in before.collect()}


def test_run_is_the_stages(spark, stages):
    assert cp.run(spark, SF).select("doc_id", "piece", "ids_crc32").exceptAll(stages[4][1].select("doc_id", "piece", "ids_crc32")).count() == 0


def test_odd_tables(spark):
    for stage in (f for _, f in cp.STAGES):
        assert stage(spark, empty_documents(spark), SF).count() == 0
    text = "some words that are the same in both of these rows here"
    rows = [(None, None, None, None, None), (5, text, "en", "s", 1), (5, text, "en", "s", 1), (None, text, "en", None, 2), (6, "", "en", "s", 0)]
    odd = spark.createDataFrame(rows, DOC).withColumn("row", F.lit(1)).withColumn("id", F.lit("x"))
    kept = cp.one_of_each_group(spark, odd, SF).collect()
    assert sorted(r["doc_id"] for r in kept) == [5, 6]
    assert cp.packed(spark, odd, SF).where("piece = 0").count() == 5
    assert cp.without_benchmark(spark, odd, SF).columns == odd.columns == quality.select(odd, quality.fit(odd, table(spark, SF, "labels"), F.lit(0), 2), 1).columns
    assert decontam.leaks(odd, table(spark, SF, "benchmark")).count() == 0
