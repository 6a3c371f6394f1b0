"""The driver's contract and the facade."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lipika.engine import Engine

DATA = "/root/testdata/sf0.001"


def test_contract():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    assert all(q.__doc__ for q in queries.values())


def test_core_stands_alone():
    """Nothing outside the training-data package imports it."""
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent / "lipika"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "lipika.llm" not in p.read_text(encoding="utf-8"), p


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0


def test_sql_agrees(spark):
    """Every core statement agrees with its query on the smallest tables (the driver compares larger ones)."""
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    from lipika.plans import oracle, queries

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    norm = lambda rows: sorted(tuple(str(round(v, 6) if isinstance(v, float) else v) for v in r) for r in rows)
    for name, sql in oracle.oracle_sql().items():
        df = queries.queries()[name](spark, DATA)
        columns = sorted(df.columns)
        want = con.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({sql})").fetchall()
        assert norm(df.select(*columns).collect()) == norm(want), name


def test_engine(spark, tmp_path):
    rows = [(1, "a", "Rigveda RV 10.129", "1. Then was not non-existent nor existent\n2. Death was not then", "vedic", "en"), (2, "b", "Notes on fire", "fire and the altar of the dawn", "vedic", "en"), (3, "c", None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, id string, title string, text string, tradition string, language string")
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("source_url", "license", "work", "fingerprint")} | {c: F.lit(None).cast("int") for c in ("book", "hymn")} | {"n_chars": F.lit(None).cast("long")})
    df.write.parquet(str(tmp_path / "documents.parquet"))
    e = Engine(spark, str(tmp_path))
    assert e.build_index() == 2
    hits = e.search("nasadiya existent", 3).orderBy("rank").collect()
    assert hits[0].title == "Rigveda RV 10.129"
    events = list(e.ask_events("fire altar"))
    assert events[0]["event"] == "meta" and events[-1]["event"] == "done"
    assert e.verse("RV.10.129.1").count() == 1
    assert e.listing(q="fire").count() == 1
    with pytest.raises(ValueError):
        e.search(" ")
    assert e.index_stats()["documents"] == 2
    df.where("doc_id <> 2").withColumn("text", F.when(F.col("doc_id") == 3, "a new text about the moon").otherwise(F.col("text"))).write.mode("overwrite").parquet(str(tmp_path / "other.parquet"))
    spark.read.parquet(str(tmp_path / "other.parquet")).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    changed = spark.createDataFrame([(2,), (3,)], "doc_id long")
    assert e.update_index(changed) == 2 and 3 in {r.doc_id for r in e.search("moon", 2).collect()}
    said = e.explain("RV.10.129.1", lambda p: '{"words": [{"word": "a", "lemma": "b", "meaning": "c"}]}' if "existent" in p["user"] else "", "Explain")
    assert said["words"][0]["lemma"] == "b" and e.explain("RV.1.1.1", lambda p: "", "Explain") is None
    assert list(e.ask_events(""))[0]["event"] == "error"
