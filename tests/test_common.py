"""Plan helpers: size-checked broadcast with a fallback, lineage cuts in the
session's checkpoint folder."""

from tapflow.operators import common


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _hinted(df):
    return "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()


def test_broadcast_only_within_the_bound(spark):
    assert _hinted(common.sized_broadcast(spark.range(10)))
    assert _hinted(common.sized_broadcast(spark.range(1000), max_bytes=8000))
    assert not _hinted(common.sized_broadcast(spark.range(1000), max_bytes=7999))


def test_a_table_that_grows_is_checked_again(spark, tmp_dir):
    spark.range(10).write.parquet(f"{tmp_dir}/t")
    first = common.sized_broadcast(spark.read.parquet(f"{tmp_dir}/t"), max_bytes=4000)
    spark.range(10_000).write.mode("append").parquet(f"{tmp_dir}/t")
    assert _hinted(first) and not _hinted(common.sized_broadcast(spark.read.parquet(f"{tmp_dir}/t"), max_bytes=4000))


def test_stops_of_a_large_network_are_not_broadcast(spark, tmp_dir):
    """800,000 stop rows, more than 100 MB as a hash table, of a file of 1 to 2 MB."""
    from tapflow.sources import fixtures
    spark.range(400_000).selectExpr("id as p_partkey", "cast(1 + id * 7919 % 50 as int) as p_size") \
        .write.parquet(f"{tmp_dir}/part.parquet")
    spark.sql("select id as event_id, timestamp'2024-01-08 08:00:00' as ts, id as user_id, 'tap' as event_type, 1.5D as value "
              "from range(10)").write.parquet(f"{tmp_dir}/events.parquet")
    taps, routes = fixtures.load(spark, tmp_dir)
    assert not _hinted(taps)
    assert taps._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 2
    assert routes.count() == 800_000 and taps.count() == 10


def test_tables_are_removed(spark):
    import os
    out = common.cut_lineage(spark.range(5))
    folder = os.path.dirname(out.inputFiles()[0].split(":", 1)[1])
    folder = "/" + folder.lstrip("/")
    assert os.path.isdir(folder) and out.count() == 5
    common.drop_tables()
    assert not os.path.exists(folder)


def test_persisted_is_released(spark):
    from tapflow.sources import sinks
    df = sinks.persisted(spark.range(100).selectExpr("id * 2 as x"))
    assert df.count() == 100 and df.storageLevel.useMemory
    df.unpersist()
    assert not df.storageLevel.useMemory


def test_workers_need_no_copy_of_the_package(tmp_dir):
    """A pair query started from another folder, with the package on the
    driver's path only."""
    import os
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {repo!r})\n"
            "from pyspark.sql import SparkSession\n"
            "s = (SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')\n"
            "     .config('spark.sql.shuffle.partitions', '2').getOrCreate())\n"
            "import __spark_entry__ as e\n"
            "print('ROWS', e.queries()['silhouette_score'](s, '/root/testdata/sf0.001').count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_dir, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 1" in done.stdout, done.stderr[-2000:]


def test_cut_lineage_writes_under_the_checkpoint_dir(spark):
    df = spark.range(5).selectExpr("id", "id * 2 as twice")
    out = common.cut_lineage(df)
    base = common.ensure_checkpoint_dir(spark)
    files = out.inputFiles()
    assert files and all(f.startswith(base.rstrip("/")) or base.split(":", 1)[-1] in f for f in files)
    assert sorted(r.twice for r in out.collect()) == [0, 2, 4, 6, 8]
    assert "LogicalRDD" not in _plan(out) and "Range" not in _plan(out)
