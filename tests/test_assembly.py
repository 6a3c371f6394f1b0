"""Assembly, training data preparation, reranking, fetching."""

import pytest
from pyspark.sql import functions as F

from lipika.operators import assembly, hybrid, training, units
from lipika.sources import fetch


def test_witness_texts(spark):
    w = "array<struct<role:string,text:string>>"
    df = spark.createDataFrame([([("en", "fire"), ("sa", " "), ("iast", "agnim")],), ([],), (None,)], f"w {w}")
    assert [r[0] for r in df.select(assembly.source_text(F.col("w"))).collect()] == ["agnim", None, None]
    assert df.select(assembly.reference_block(F.col("w"))).first()[0] == "[en] fire\n[iast] agnim"


def test_answers_read_back(spark):
    raw = ['```json\n{"words": [{"word": "a", "lemma": "b", "meaning": "c"}]}\n```', '{"words": []}', "nothing", None]
    df = spark.createDataFrame([(r,) for r in raw], "a string")
    assert [[w.word for w in r[0]] for r in df.select(assembly.parse_words(F.col("a"))).collect()] == [["a"], [], [], []]


def test_keys_and_prompts(spark):
    df = spark.createDataFrame([("RV 1.1/1", "pt", "x", None)], "v string, l string, a string, b string")
    key = df.select(assembly.cache_key(F.col("v"), F.col("l"), F.col("a"), F.col("b")).alias("cache_key"))
    assert key.first()[0].startswith("RV_1.1_1-pt-")
    assert assembly.missing_from_cache(key, key).count() == 0
    assert df.select(assembly.prompt(F.col("a"), F.col("b"), "p")).first()[0].user == "x"
    assert df.select(assembly.meaning(F.lit("a \n b" * 400))).first()[0] == ("a b" * 400)[:700]


def test_strict_markers():
    assert assembly.strict_title_match("Rigveda RV 10.129", ["Rig Veda", "10.129"])
    assert not assembly.strict_title_match("Rig Veda 10.1290", ["Rig Veda", "10.129"])
    assert assembly.strict_title_match("The Rig Veda", ["Rig Veda"]) and not assembly.strict_title_match(None, ["", None])


def test_groups():
    u = lambda v, n=10, hymn=1: {"work": "rigveda", "book": 1, "hymn": hymn, "verse": v, "text": "x" * n}
    assert [[x["verse"] for x in g] for g in units.grouped([u(1), u(2), u(3), u(5), u(6, hymn=2), u(7, 195, 2), u(None)])] == [[1, 2], [3], [5], [6, 7], [None]]
    assert [len(g) for g in units.grouped([u(1, 150), u(2, 60)], size=10)] == [1, 1]
    assert units.grouped([]) == []


def test_training_blocks(spark):
    make = lambda: lambda texts: [[1] * len(t) for t in texts]
    df = spark.createDataFrame([("abc",), (None,), ("defgh",), ("",)], "text string").coalesce(1)
    assert [r.block for r in training.blocks(df, make, 3).collect()] == [[1, 1, 1], [1, 1, 1]]
    assert tuple(training.compression(df, make).first()) == (2, 8, 8, 1.0, 4.0)
    assert training.compression(df.where("false"), make).first().ratio is None
    P = pytest.importorskip("public_tokenizers")
    assert training.compression(df, training.public_tokenizer(P.path("byte_bpe_50k.json"))).first().tokens > 0


def test_rerank(spark):
    hits = spark.createDataFrame([(1, "a", 0.9), (2, "b", 0.5)], "rank int, text string, score double")
    good = hybrid.rerank(hits, "q", lambda: lambda pairs: [-9.0 if t == "a" else 9.0 for _, t in pairs]).orderBy("rank").collect()
    assert [r.text for r in good] == ["b", "a"]
    bad = hybrid.rerank(hits, "q", lambda: 1 / 0).orderBy("rank").collect()
    assert [(r.text, r.score) for r in bad] == [("a", 0.9), ("b", 0.5)]


def test_fetch(tmp_path):
    (tmp_path / "x.txt").write_text("abc")
    got = fetch.fetch(str(tmp_path / "x.txt"), str(tmp_path / "raw"), "A title", base=str(tmp_path))
    assert got.read_text() == "abc" and got.suffix == ".txt"
    with pytest.raises(ValueError):
        fetch.fetch("/etc/hostname", str(tmp_path / "raw"), base=str(tmp_path))
    with pytest.raises(ValueError):
        fetch.fetch(str(tmp_path / "x.txt"), str(tmp_path / "raw"), base=str(tmp_path), most=1)
    assert not fetch.safe_url("http://127.0.0.1/")[0] and not fetch.safe_url("ftp://x/")[0] and not fetch.safe_url("http://localhost/")[0]
