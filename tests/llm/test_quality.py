import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from ledgerlens.llm import quality
from ledgerlens.llm.common import table
from ledgerlens.llm.queries import quality_grade
from tests.llm.helpers import documents, empty_documents, odd_documents


def test_gradient_reaches_the_optimum():
    """One feature apart from the constant: the fit comes close to the frequencies of the grades."""
    rng = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(4000):
        has = rng.random() < 0.5
        p = [0.1, 0.2, 0.7] if has else [0.6, 0.3, 0.1]
        rows.append(np.array([3] if has else [], np.int32))
        grades.append(int(rng.choice(3, p=p)))
    model = quality.fit_ordinal(rows, np.array(grades), 3)
    assert model.thresholds[0] < model.thresholds[1]
    assert model.tails(np.array([3], np.int32)) == pytest.approx([0.9, 0.7], abs=0.06)
    assert model.tails(np.array([], np.int32)) == pytest.approx([0.4, 0.1], abs=0.06)


def test_held_out_grades(spark):
    """Labels are split: a model of two thirds tells the rest apart."""
    sf = SF.replace("sf0.001", "sf0.1")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.fit(docs, labels.where("doc_id % 3 <> 0"), quality_grade(), 3)
    out = quality.predict(docs, model).withColumn("keep", F.col("tails")[1] >= 0.5)
    held = out.join(labels.where("doc_id % 3 = 0").withColumn("g", quality_grade()), out.id == labels.doc_id)
    rate = {r["g"]: r["k"] for r in held.groupBy("g").agg(F.avg(F.col("keep").cast("double")).alias("k")).collect()}
    assert rate[0] < 0.05 and rate[1] < 0.3 and rate[2] > 0.97


def test_bounded_sample(spark):
    docs = documents(spark, [f"good word{i}" if i % 2 else f"bad word{i}" for i in range(400)])
    labels = spark.range(400).selectExpr("id AS doc_id", "id % 2 AS quality", "0 AS toxic")
    model = quality.fit(docs, labels, quality_grade(), 3, sample=100)
    rows = {r["id"]: r["expected_grade"] for r in quality.predict(docs, model).collect()}
    assert min(rows[i] for i in range(1, 400, 2)) > max(rows[i] for i in range(0, 400, 2))


def test_odd_rows(spark):
    df = odd_documents(spark)
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (4, 0, 0), (5, None, 1), (None, 1, 1), (999, 1, 1), (6, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels, quality_grade(), 3)
    rows = quality.predict(df, model).collect()
    assert len(rows) == df.count() and all(0 <= r["expected_grade"] <= 2 for r in rows)
    assert all(r["tails"][0] >= r["tails"][1] for r in rows)
    nothing = quality.fit(df, labels.limit(0), quality_grade(), 3)
    assert quality.select(df, nothing, 2).count() == df.count()
    only = quality.fit(df, labels.where("doc_id = 4"), quality_grade(), 3)
    assert quality.select(df, only, 1).count() == 0
    assert quality.predict(empty_documents(spark), model).count() == 0
    assert quality.select(df, model, 2).columns == df.columns
