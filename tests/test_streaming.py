import numpy as np
from pyspark.sql import functions as F

from lumenframe.operators import frames
from lumenframe.operators.frames import Geometry
from lumenframe.streaming import chunks

G = Geometry(4, 4)


def _chunk(spark, path, first, n):
    rows = [(i, bytearray(((np.arange(16) * (i + 1)) % 97).astype("<u2").tobytes())) for i in range(first, first + n)]
    spark.createDataFrame(rows, "frame_id long, pixels binary").coalesce(1).write.mode("append").parquet(path)


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for k in range(3):
        _chunk(spark, src, 4 * k, 4)
    schema = "frame_id long, pixels binary"
    stream = chunks.chunk_stream(spark, src, schema)
    q = chunks.reduce_stream(stream, np.full(16, 20), 3, G, out, str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = frames.unpack_records(spark.read.parquet(out), G)
    want = frames.reduce_l1(spark.read.schema(schema).parquet(src), np.full(16, 20), 3, G)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_validation_batches_and_view(spark, tmp_path):
    src = str(tmp_path / "src")
    _chunk(spark, src, 0, 8)
    schema = "frame_id long, pixels binary"
    q = chunks.each_batch(chunks.chunk_stream(spark, src, schema), lambda b: chunks.validation_dose(b, np.full(16, 20), 0, G, 2, 4), str(tmp_path / "dose"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert {r.frame_id % 2 for r in spark.read.parquet(str(tmp_path / "dose")).collect()} == {0}
    l1 = frames.reduce_l1(spark.read.schema(schema).parquet(src), np.full(16, 20), 0, G)
    view = chunks.live_view(l1, 4, 100.0)
    assert view.agg(F.sum("sum_v")).first()[0] == l1.agg(F.sum("v")).first()[0]
    assert view.select("window").distinct().count() == 2


def test_numbering(spark):
    rows = [(c, i) for c, n in ((0, 3), (1, 2), (5, 4)) for i in range(n)]
    got = chunks.numbered(spark.createDataFrame(rows, "chunk_id long, index int")).orderBy("chunk_id", "index").select("frame_id").collect()
    assert [r.frame_id for r in got] == list(range(9))


def test_late_duplicates_are_dropped(spark, tmp_path):
    src = str(tmp_path / "src")
    _chunk(spark, src, 0, 4)
    _chunk(spark, src, 2, 4)
    s = chunks.deduplicated(chunks.chunk_stream(spark, src, "frame_id long, pixels binary", per_trigger=5), 100.0)
    q = s.select("frame_id").writeStream.format("memory").queryName("dedup").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.frame_id for r in spark.sql("SELECT * FROM dedup").collect()) == list(range(6))
