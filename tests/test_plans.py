"""The analysis steps end to end, and the stream against the batch."""

from tributary.operators import cascades
from tributary.plans.pipeline import run
from tributary.sources import tables
from tributary.streaming.cascades import first_adoptions, user_stats_sink

FOLDER = "/root/testdata/sf0.001"


def test_steps(spark, tmp_path):
    r = run(spark, FOLDER, str(tmp_path / "out"), ("cascade", "alpha", "inference", "communities", "centrality"))
    c = r.get("centrality")
    assert c.count() == r.get("nodes").count() > 0 and "pagerank_lph" in c.columns
    assert r.get("scores").select("node").distinct().count() == r.get("users").count()


def test_stream_equals_batch(spark, tmp_path):
    events = tables.read(spark, FOLDER, "events")
    src, out = str(tmp_path / "in"), str(tmp_path / "stats")
    events.repartition(3).write.parquet(src)
    q = first_adoptions(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)).writeStream.outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(user_stats_sink(out)).start()
    q.processAllAvailable()
    q.stop()
    a = tables.adoptions(spark, FOLDER)
    want = cascades.user_stats(cascades.cascades(a), a.select("user_id"))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, want.collect()))
