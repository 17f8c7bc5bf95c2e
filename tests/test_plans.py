"""Plan shapes that the scale design relies on, and a hot-key batch."""

from pyspark.sql import functions as F

from mediashelf.operators import search, summary
from mediashelf.operators import upsert as U
from mediashelf.operators.prefix_join import longest_prefix_mount
from mediashelf.sources import catalogue as cat

from .conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_summary_aggregates_files_before_the_join(spark):
    s = summary.device_summary(cat.devices(spark, SF_SMALL), cat.files(spark, SF_SMALL))
    p = s._jdf.queryExecution().optimizedPlan().toString()
    # the aggregate sits below the join: files are reduced per (device, system) first
    assert p.index("Join LeftOuter") < p.index("Aggregate")
    ex = plan(s)
    assert "HashAggregate" in ex and "partial_count" in ex


def test_page_is_top_k_without_global_sort(spark):
    df = search.search_files(cat.files(spark, SF_SMALL), cat.devices(spark, SF_SMALL), keyword="high", limit=10)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in final
    assert "BroadcastHashJoin" in final or "BroadcastExchange" in final


def test_prefix_join_broadcasts_small_mounts(spark):
    mounts = spark.createDataFrame([("/a", "u1"), ("/a/b", "u2")], "mount_path string, uuid string")
    paths = spark.range(0, 1000).select(F.col("id"), F.concat(F.lit("/a/b/"), F.col("id").cast("string")).alias("path"))
    out = longest_prefix_mount(paths, mounts)
    assert out.where(F.col("mount_path") == "/a/b").count() == 1000
    assert "BroadcastHashJoin" in plan(out)


def test_insert_path_reads_only_key_columns(spark):
    files = cat.files(spark, SF_SMALL)
    batch = cat.file_batch(spark, SF_SMALL).where("error IS NULL").select("device_uuid", "path", "system_id", "size")
    ins = batch.join(files.select("device_uuid", "path", "system_id"), ["device_uuid", "path", "system_id"], "left_anti")
    p = ins._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in p and "ReadSchema" in p
    # neither scan of orders reads the price (the size column of files): the big side
    # contributes its key columns only
    assert "o_totalprice" not in p


def test_hot_key_batch(spark):
    # one key holds a third of the batch rows: partial aggregation keeps the result exact
    n = 30000
    rows = spark.range(0, n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("path"),
        F.lit("dev").alias("device_uuid"), F.lit("s").alias("system_id"),
        F.col("id").alias("size"), F.col("id").alias("ord"))
    last = U.latest_per_key(rows, ["device_uuid", "path", "system_id"], "ord")
    assert last.count() == 1 + 2 * n // 3
    hot = last.where(F.col("path") == "hot").first()
    assert hot["ord"] == max(i for i in range(n) if i % 3 == 0)
    assert "partial" in plan(last).lower() or "SortAggregate" in plan(last)
    current = spark.createDataFrame([(1, "dev", "hot", "s", 5)], "id long, device_uuid string, path string, system_id string, size long")
    res = U.upsert(current, rows, ["device_uuid", "path", "system_id"], ["size"], order_col="ord", stamp_col=None)
    t = res.table
    assert t.count() == 1 + 2 * n // 3
    assert t.where("path = 'hot'").first()["id"] == 1
    assert t.select("id").distinct().count() == t.count()


def test_salted_top_n_matches_plain_window(spark):
    from pyspark.sql import Window
    from mediashelf.operators._util import top_n_per_group
    df = spark.range(0, 20000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("g"),
        ((F.col("id") * 7919) % 20000).alias("v"))
    got = sorted(map(tuple, top_n_per_group(df, ["g"], [F.col("v").desc()], 10, salt_col="v").collect()))
    w = Window.partitionBy("g").orderBy(F.col("v").desc())
    want = sorted(map(tuple, df.withColumn("r", F.row_number().over(w)).where("r <= 10").drop("r").collect()))
    assert got == want


def test_bucketed_catalogue_shuffles_only_the_batch(spark, tmpdir_path):
    import os
    from mediashelf.operators import sync as S
    from mediashelf.plans import q_upsert
    from mediashelf.schemas import BUCKET_KEYS, KEYS
    from mediashelf.sources.tables import save_bucketed
    old = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    try:
        keys = KEYS["files"]
        files = save_bucketed(cat.files(spark, SF_SMALL), "files_bucketed_test", BUCKET_KEYS["files"], buckets=4,
                              path=os.path.join(tmpdir_path, "files_b"))
        batch = q_upsert._clean_batch(spark, SF_SMALL)
        res = U.upsert(files, batch, keys, ["hash", "size"], as_of="2024-01-01 00:00:00",
                       order_col=q_upsert.ORDER())
        p = plan(res.table)
        scan_line = [line for line in p.splitlines() if "files_bucketed_test" in line][0]
        assert "Bucketed: true" in scan_line
        # the only hash exchange in the update join is the batch side's
        assert p.count("Exchange hashpartitioning") == 1
        # the sync round (2-column key) needs no exchange at all on the bucketed table
        assert "Exchange hashpartitioning" not in plan(S.sync_files(files, "sys-1", "1996-01-01 00:00:00"))
        want = U.upsert(cat.files(spark, SF_SMALL), batch, keys, ["hash", "size"], as_of="2024-01-01 00:00:00",
                        order_col=q_upsert.ORDER()).table
        assert sorted(map(tuple, res.table.collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", old)
