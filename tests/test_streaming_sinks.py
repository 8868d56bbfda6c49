from datetime import datetime

from frames import taps
from tapflow.sources import sinks
from tapflow.streaming import live


def test_windowed_od_counts_stream(spark, tmp_dir):
    t = taps(spark, [("a", "b", "B1", "1", datetime(2024, 1, 8, 8, 5)),
                     ("a", "b", "B1", "1", datetime(2024, 1, 8, 8, 50)),
                     ("a", "c", "B1", "1", datetime(2024, 1, 8, 9, 10))])
    src = f"{tmp_dir}/taps"
    t.write.parquet(src)
    stream = live.stream_taps(spark, src, t.schema)
    q = (live.windowed_od_counts(stream).writeStream.outputMode("update").format("memory")
         .queryName("od_stream_test").start())
    q.processAllAvailable()
    q.stop()
    got = {(r.source, r.destination, r.window_start.hour): r.pax
           for r in spark.sql("select * from od_stream_test").collect()}
    assert got == {("a", "b", 8): 2, ("a", "c", 9): 1}


def test_partitioned_write_and_single_file(spark, tmp_dir):
    t = taps(spark, [("a", "b"), ("a", "c")])
    sinks.write_table(t, f"{tmp_dir}/out", partition_by=["service"])
    assert spark.read.parquet(f"{tmp_dir}/out").count() == 2
    sinks.write_table(t, f"{tmp_dir}/csv", fmt="csv", single_file=True)
    assert spark.read.option("header", True).csv(f"{tmp_dir}/csv").count() == 2
