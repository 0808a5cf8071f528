"""Snapshots: names by content, shared objects, and every way in which a file can go wrong."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import snapshots


def test_names_sharing_and_reading(spark, tmp_path):
    store = f"{tmp_path}/store"
    rows = spark.range(3000).select("id", F.concat(F.lit("v"), "id").alias("v"), F.when(F.col("id") % 5 > 0, F.col("id") * 2).alias("n"))
    first = snapshots.commit(rows, store, ["id"], buckets=8)
    assert snapshots.commit(rows.repartition(7).select("n", "v", "id").select("id", "v", "n"), store, ["id"], buckets=8) == first
    assert len(list((tmp_path / "store" / "objects").iterdir())) == 1  # the second commit wrote nothing
    moved = rows.withColumn("v", F.when(F.col("id") == 7, "new").otherwise(F.col("v")))
    second = snapshots.commit(moved, store, ["id"], buckets=8)
    assert second != first and sorted(r["shared"] for r in snapshots.shared(spark, store, second, first).collect()) == [False] + [True] * 7
    assert sorted(map(tuple, snapshots.read(spark, store, second).collect())) == sorted(map(tuple, moved.collect()))
    assert sorted(map(tuple, snapshots.read(spark, store, first).collect())) == sorted(map(tuple, rows.collect()))
    none = snapshots.commit(rows.where("false"), store, ["id"])
    assert snapshots.read(spark, store, none).collect() == [] and snapshots.read(spark, store, none).columns == rows.columns


def test_faults(spark, tmp_path):
    store = f"{tmp_path}/store"
    name = snapshots.commit(spark.range(100).withColumn("t", F.lit("x")), store, ["id"], buckets=4, bucket=F.col("id") % 4)
    for crc in (tmp_path / "store").rglob(".*.crc"):  # most stores keep no checksums beside files
        crc.unlink()
    files = {int(p.parent.name.split("=")[1]): p for p in (tmp_path / "store" / "objects").rglob("*.parquet")}
    assert snapshots.faults(spark, store, name).collect() == []
    files[0].unlink()
    files[1].write_bytes(files[1].read_bytes() + b"!")
    whole = bytearray(files[2].read_bytes())
    whole[len(whole) // 2] ^= 1
    files[2].write_bytes(bytes(whole))
    assert {(r["bucket"], r["fault"]) for r in snapshots.faults(spark, store, name).collect()} == {(0, "missing"), (1, "size"), (2, "altered")}
    with pytest.raises(snapshots.Altered):
        snapshots.read(spark, store, name)
    manifest = tmp_path / "store" / "manifests" / f"{name}.json"
    manifest.write_text(manifest.read_text().replace('"rows": 25', '"rows": 26', 1))
    for wrong in (name, "0" * 64):
        with pytest.raises(snapshots.Altered):
            snapshots.manifest(spark, store, wrong)


def test_buckets_out_of_range(spark, tmp_path):
    rows = spark.range(10)
    for bad in (F.col("id"), F.lit(None).cast("int"), F.lit(-1)):
        with pytest.raises(ValueError):
            snapshots.commit(rows, f"{tmp_path}/s", ["id"], buckets=4, bucket=bad)
    with pytest.raises(ValueError):
        snapshots.commit(rows, f"{tmp_path}/s", ["id"], buckets=0)
