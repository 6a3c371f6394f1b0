"""Streams against their batch forms, and restart of an ingest."""

from pyspark.sql import functions as F

from lipika.operators import ranking
from lipika.streaming import ingest, limiter
from lipika.streaming.jobs import Jobs


def test_limiter_equals_batch(spark, tmp_path):
    rows = [(u, 1_700_000_000 + s) for u in ("a", "b") for s in (0, 1, 2, 3, 61, 62, 63, 64, 200)]  # a fresh watermark stands at the epoch
    df = spark.createDataFrame(rows, "user string, s long").select("user", F.timestamp_seconds("s").alias("ts"))
    src = str(tmp_path / "in")
    df.coalesce(1).write.parquet(src)
    stream = limiter.limit_stream(spark.readStream.schema(df.schema).parquet(src), "user")
    q = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.user, r.ts, r.allowed) for r in spark.table("limited").collect())
    want = sorted((r.user, r.ts, r.allowed) for r in ranking.windows_by_first(df, ["user"], "ts", 60, 3).collect())
    assert got == want and len(got) == len(rows)


def test_counters(spark, tmp_path):
    df = spark.range(10).select((F.col("id") % 2).alias("k"), F.timestamp_seconds("id").alias("ts"))
    src = str(tmp_path / "in")
    df.write.parquet(src)
    q = limiter.counters(spark.readStream.schema(df.schema).parquet(src), "k").writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.k, r.events) for r in spark.table("counted").collect()) == [(0, 5), (1, 5)]


def test_ingest_resumes(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()
    (src / "a.txt").write_text("A text long enough to be kept. " * 5)
    (src / "b.txt").write_text("A text long enough to be kept. " * 5)
    (src / "c.txt").write_text("short")
    ingest.ingest_folder(spark, str(src), out, cp).awaitTermination()
    assert spark.read.parquet(out).count() == 1
    (src / "d.txt").write_text("Another text that is long enough. " * 5)
    (src / "e.txt").write_text("A text long enough to be kept. " * 5)
    ingest.ingest_folder(spark, str(src), out, cp).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_jobs(spark):
    jobs = Jobs(spark, keep=3)
    ok = jobs.submit("count", lambda s: s.range(5).count())
    bad = jobs.submit("fail", lambda s: 1 / 0)
    assert jobs.wait(ok) == 5 and jobs.wait(bad) is None
    assert {r.job_id: r.status for r in jobs.table().collect()} == {ok: "done", bad: "error"}


def test_jobs_outlive_the_process(spark, tmp_path):
    import json

    jobs = Jobs(spark, folder=str(tmp_path))
    done = jobs.submit("count", lambda s: s.range(5).count())
    jobs.wait(done)
    (tmp_path / "abc.json").write_text(json.dumps({"job_id": "abc", "kind": "k", "status": "running", "created_at": "2025-01-01T00:00:00+00:00", "finished_at": None, "error": None}))
    (tmp_path / "bad.json").write_text("{")
    again = Jobs(spark, folder=str(tmp_path))
    assert again.get(done)["status"] == "done" and again.get("abc")["error"] == "interrupted" and again.get("bad") is None
    assert again.table(0).count() == 1
    assert json.loads((tmp_path / "abc.json").read_text())["status"] == "error"


def test_exposition(spark):
    df = spark.createDataFrame([("b", 2), ('a"\n\\', 1)], "k string, events long")
    assert [r.line for r in limiter.exposition(df, "n", ("k",)).collect()] == ['n{k="a\\"\\n\\\\"} 1', 'n{k="b"} 2']


def test_large_files_are_told(spark, tmp_path, monkeypatch):
    from lipika.sources import files

    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()
    (src / "a.txt").write_text("A text long enough to be kept. " * 5)
    (src / "b.txt").write_text("x" * 5_000)
    monkeypatch.setattr(files, "MAX_BYTES", 1_000)
    ingest.ingest_folder(spark, str(src), out, cp).awaitTermination()
    assert spark.read.parquet(out).count() == 1 and [r.error for r in spark.read.parquet(f"{out}.errors").collect()] == ["file too large"]
