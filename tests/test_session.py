from pyspark.sql import functions as F

from markwise import session


def test_a_written_tables_shuffles_and_garbage_go(spark, monkeypatch):
    monkeypatch.setattr(session, "COLLECT_S", 0.0)
    kept = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    session.written(spark.range(1).groupBy("id").count())
    before, setting = kept.size(), spark.conf.get(session.LET_GO)
    table = session.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert kept.size() <= before and spark.conf.get(session.LET_GO) == setting
    assert {r.k for r in table.collect()} == set(range(7))
