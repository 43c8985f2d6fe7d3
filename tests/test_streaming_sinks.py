import os

from ledgerlens.sources import sinks
from ledgerlens.sources.fixtures import fixture
from ledgerlens.streaming.incremental import match_stream

from conftest import SF


def test_stream_matches_like_batch(spark, tmpdir_path):
    a = fixture(spark, SF, "fx_match_a")
    b = fixture(spark, SF, "fx_match_b")
    src = os.path.join(tmpdir_path, "in")
    a.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(a.schema).parquet(src)
    out = os.path.join(tmpdir_path, "out")
    q = match_stream(stream, b, "item", "item", out, extract=["id"], b_order="id",
                     checkpoint=os.path.join(tmpdir_path, "ckpt"), query_name="t_match")
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    assert got.count() == a.count()
    assert got.filter("category = 'matched'").count() > 0


def test_sinks_write(spark, tmpdir_path):
    df = fixture(spark, SF, "fx_sales").limit(50)
    sinks.write_csv(df, os.path.join(tmpdir_path, "csv"))
    sinks.write_json(df, os.path.join(tmpdir_path, "json"))
    lines = sinks.statistical_summary(df, "sales")
    sinks.write_text(lines, os.path.join(tmpdir_path, "txt"))
    assert spark.read.option("header", True).csv(os.path.join(tmpdir_path, "csv")).count() == 50
    assert spark.read.text(os.path.join(tmpdir_path, "txt")).count() == 5
