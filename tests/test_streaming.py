import pyarrow as pa
import pyarrow.parquet as pq

from prismlake.sources import sinks
from prismlake.streaming import ingest


def test_files_stream(spark, tmp_path):
    import numpy as np

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tif").write_bytes(sinks.tiff(np.zeros((2, 2, 3), np.uint8)))
    (tmp_path / "in" / "b.PNG").write_bytes(sinks.png(np.zeros((2, 2, 3), np.uint8)))
    q = ingest.files(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.decoder, r.kind) for r in spark.table("arrived").collect()) == [("TIFF", "TIFF little"), ("bitmap", "PNG")]


def test_windows(spark, tmp_path):
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=m), "crop", float(m)) for m in (0, 1, 6, 40)]
    (tmp_path / "log").mkdir()
    pq.write_table(pa.table({"ts": pa.array([r[0] for r in rows], pa.timestamp("us", "UTC")), "effect": [r[1] for r in rows], "value": [r[2] for r in rows]}), tmp_path / "log" / "a.parquet")
    log = spark.readStream.schema("ts timestamp, effect string, value double").parquet(str(tmp_path / "log"))
    q = ingest.edits_by_window(log).writeStream.format("memory").queryName("edits").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("edits").collect()) == [1, 2]
