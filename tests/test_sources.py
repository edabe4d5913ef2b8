"""Sources, sinks and streams on small fixtures."""

from pyspark.sql import functions as F

from trovesift.config import Settings
from trovesift.sources import files, stores
from trovesift.streaming import pipelines


def test_scan_and_extract(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    for name, data in (("a.md", b"# x\r\n\r\n\r\n\r\ny"), ("b.txt", "caf\xe9".encode("latin-1")), ("c.txt", b"\x00\x01bin"), ("d.png", b"%PNG"), ("node_modules/e.js", b"x")):
        (tmp_path / name).write_bytes(data)
    found = {r.name: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert found["a.md"].kind == "markdown" and found["e.js"].verdict == "exclude" and found["b.txt"].size == 4
    texts = {r.path.rpartition("/")[2]: r for r in files.extract(spark, str(tmp_path)).collect()}
    assert texts["a.md"].text == "# x\n\ny" and texts["b.txt"].text == "café"
    assert texts["c.txt"].status == "unsupported" and texts["d.png"].status == "unsupported"


def test_versioned_table(spark, tmp_path):
    table = stores.VersionedTable(spark, str(tmp_path / "t"), "item_id long, chunk string")
    assert table.read().count() == 0
    table.write(spark.createDataFrame([(1, "a"), (2, "b")], table.schema))
    table.replace_keys(spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], table.schema), "item_id")
    assert sorted(map(tuple, table.read().collect())) == [(1, "a"), (2, "c"), (2, "d"), (3, "e")]
    table.delete_keys(spark.createDataFrame([(1,)], "item_id long"), "item_id")
    assert table.read().count() == 3 and table.version() == 2


def test_vector_store(spark, tmp_path):
    store = stores.VectorStore(spark, str(tmp_path / "v"), 2)
    df = spark.createDataFrame([(1, 0, [1.0, 0.0])], "item_id long, passage int, embedding array<double>")
    store.write("v1", df)
    store.write("v2", df.withColumn("item_id", F.lit(9).cast("long")))
    store.activate("v2")
    assert [r.item_id for r in store.active().collect()] == [9]


def test_settings(spark, tmp_path):
    stores.SettingsStore(spark, str(tmp_path / "s")).save(Settings(junk_weight=7.0))
    assert stores.SettingsStore(spark, str(tmp_path / "s")).load() == Settings(junk_weight=7.0)


def test_merge_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("a", "new", 1), ("a", "modified", 2), ("b", "new", 3), ("b", "delete", 4)]
    spark.createDataFrame(rows, "path string, kind string, seq long").write.parquet(source)
    pipelines.merge_changes(pipelines.stream_table(spark, source), out, str(tmp_path / "c"))
    assert [tuple(r) for r in pipelines.catalog(spark, out).collect()] == [("a", "modified", 2)]
