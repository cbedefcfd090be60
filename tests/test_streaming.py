import json

from foreband.streaming.hourly import arriving_chunks, hourly_stream


def test_stream_equals_batch_sums(spark, tmp_path):
    start = 1700000400000 - 1700000400000 % 3600000
    for i in range(3):
        series = [[start + i * 7200000 + k * 900000, float(k)] for k in range(8)]
        (tmp_path / f"c{i}.json").write_text(json.dumps({"series": series}))
    stream = hourly_stream(arriving_chunks(spark, str(tmp_path), "Europe/Berlin", files_per_trigger=1))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("hourly_test").start()
    q.processAllAvailable()
    q.stop()
    got = [r["value"] for r in spark.sql("SELECT * FROM hourly_test ORDER BY at").collect()]
    assert got == [6.0, 22.0] * 3
