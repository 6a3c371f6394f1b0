"""Operators against brute force on small tables, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lipika.functions.sanskrit import tokenize
from lipika.operators import catalog, chunking, dedupe, evaluation, hybrid, lexical, ranking, records, status, units, vectors, verses

DOC = "doc_id long, id string, text string, title string, source_url string, tradition string, language string, license string, work string, book int, hymn int, n_chars long, fingerprint string"


def docs(spark, *rows):
    names = [c.split()[0] for c in DOC.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], DOC)


def test_greedy_matches_walk(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["A", "B", "C", "D", None, ""]) if rng.random() < 0.5 else f"f{rng.randrange(40)}", rng.choice([None, "", "x"]) if rng.random() < 0.3 else f"u{rng.randrange(40)}") for i in range(200)]
    kept, fps, urls = [], set(), set()
    for i, f, u in rows:
        if (f and f in fps) or (u and u in urls):
            continue
        kept.append(i)
        fps |= {f} - {None, ""}
        urls |= {u} - {None, ""}
    df = spark.createDataFrame(rows, "ord long, fp string, url string").withColumn("first_a", F.lit(1))
    assert sorted(r.ord for r in dedupe.greedy(df, "ord", ("fp", "url")).collect()) == kept
    assert dedupe.greedy(df.where("false"), "ord", ("fp", "url")).count() == 0


def test_greedy_long_chain(spark):
    """Row n shares one key with row n - 1 and the other with row n + 1: every second row stays, beyond any number of rounds."""
    rows = [(i, f"f{i // 2}", f"u{(i + 1) // 2}") for i in range(200)]
    df = spark.createDataFrame(rows, "ord long, fp string, url string")
    assert sorted(r.ord for r in dedupe.greedy(df, "ord", ("fp", "url"), rounds=3).collect()) == list(range(0, 200, 2))


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 130), (130, 115), (200, 200)]
    got = dict(map(tuple, dedupe.components(spark.createDataFrame(pairs, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(61)} | {100: 100, 130: 100, 115: 100}
    assert dedupe.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_preferred_address(spark):
    df = spark.createDataFrame([(1, 1, 2, "a/rv"), (2, 1, 2, "a/rv-long"), (3, 1, 3, "bad"), (4, None, None, "x"), (5, 1, 3, "ok")], "ord long, book int, hymn int, url string")
    assert [r.url for r in dedupe.preferred(df, ["book", "hymn"], "url", "ord", ("bad",)).collect()] == ["x", "a/rv-long", "ok"]


def test_superseded_samples_go(spark):
    long = "word " * 100
    df = docs(spark, {"doc_id": 1, "title": "Bhagavad Gita", "source_url": "fixtures/bg.txt", "text": "short", "language": "en"}, {"doc_id": 2, "title": "The Bhagavad-Gita", "source_url": "https://a.org", "text": long, "language": "en"}, {"doc_id": 3, "title": "Bhagavad Gita", "source_url": "fixtures/bg_sa.txt", "text": "short", "language": "sa"})
    assert sorted(r.doc_id for r in dedupe.superseded_samples(df).collect()) == [2, 3]


def test_greedy_against_existing(spark):
    df = spark.createDataFrame([(1, "a", "u"), (2, "b", "v"), (3, "c", "w")], "ord long, fp string, url string")
    old = spark.createDataFrame([("a", None), (None, "w")], "fp string, url string")
    assert [r.ord for r in dedupe.greedy(df, "ord", ("fp", "url"), old).collect()] == [2]


def test_superseded_and_upsert(spark):
    d = docs(spark, {"doc_id": 1, "title": "Bhagavad Gita", "source_url": "fixtures/g.txt", "text": "x"}, {"doc_id": 2, "title": "The Gita", "source_url": "http://a", "text": "x" * 3}, {"doc_id": 3, "title": None, "source_url": "fixtures/n", "text": None})
    assert sorted(r.doc_id for r in dedupe.superseded_samples(d).collect()) == [2, 3]
    t = spark.createDataFrame([("a", 1, "old"), ("b", 2, "old")], "k string, v int, c string")
    s = spark.createDataFrame([("b", 9, "new"), ("c", 3, "new")], "k string, v int, c string")
    assert sorted(map(tuple, dedupe.upsert(t, s, "k", ("c",)).collect())) == [("a", 1, "old"), ("b", 9, "old"), ("c", 3, "new")]
    kept, gone = dedupe.purge(t, s, "k")
    assert [r.k for r in kept.collect()] == ["b"] and [r.k for r in gone.collect()] == ["a"]


@pytest.mark.parametrize("text", [None, "", "  ", "abc", "a b " * 700, "x" * 2000, "line\n" * 400, "ॐ " * 900])
def test_windows_cover(text):
    body = (text or "").strip()
    spans = chunking.windows(body, 800, 120)
    assert all(b - a <= 800 for a, b in spans)
    assert not body or (spans[0][0] == 0 and spans[-1][1] == len(body))
    assert all(c <= b for (_, b), (c, _) in zip(spans, spans[1:]))


def test_units_of_each_dialect():
    rv = units.hymns("HYMN X.129 — Creation\n1. Then was not\nnon-existent\n2 Death was not\nNotes for pipeline\n3. gone", "rigveda", None, None)
    assert [(u["book"], u["hymn"], u["verse"], u["text"]) for u in rv] == [(10, 129, 1, "Then was not\nnon-existent"), (10, 129, 2, "Death was not")]
    assert rv[0]["heading"] == "Creation"
    prose = units.hymns("HYMN 1.32.\nprose here", "rigveda", 1, None)
    assert prose[0]["verse"] is None
    bg = units.chapters("CHAPTER II — Sankhya\n\n2.47 Let right deeds\nbe thy motive\n\nHERE ENDS CHAPTER II\nlost")
    assert [(u["book"], u["verse"], u["text"]) for u in bg] == [(2, 47, "Let right deeds\nbe thy motive")]
    phrase = units.chapters("CHAPTER 18\n\nFly unto me alone\n\nsomething else entirely")
    assert [(u["verse"], u["passage"]) for u in phrase] == [(66, None), (None, 2)]
    ys = units.sutras("SAMADHI PADA\n1.2 yoga is\nrestraint\n2.46 posture")
    assert [(u["book"], u["verse"], u["text"], u["heading"]) for u in ys] == [(1, 2, "yoga is\nrestraint", "Samadhi Pada"), (2, 46, "posture", "Samadhi Pada")]
    vs = units.numbered("ADHYAYA 1 — x\n1. a\n\nstray\n\n2. b", "yajurveda", None, header=units.ADHYAYA)
    assert [(u["book"], u["verse"], u["text"]) for u in vs] == [(1, 1, "a"), (1, 2, "b")]
    assert units.marked_verses("९ ऋषिः । देवता\nअ ॥१॥ आ ।।२।। क") == ("ऋषिः । देवता", [(1, "अ"), (2, "आ")])


def test_document_chunks(spark):
    d = docs(
        spark,
        {"doc_id": 1, "id": "a", "title": "Rigveda RV 10.129", "text": "\n".join(f"{i}. verse {i}" for i in range(1, 6))},
        {"doc_id": 2, "id": "b", "title": "Notes", "text": "word " * 400},
        {"doc_id": 3, "id": "c", "title": None, "text": None},
    )
    rows = chunking.chunk_documents(d.withColumn("start", F.lit(0))).orderBy("doc_id", "chunk_index").collect()
    first = [r for r in rows if r.doc_id == 1]
    assert [(r.verse, r.verse_end, r.locator) for r in first] == [(1, 2, "RV 10.129.1–2"), (3, 4, "RV 10.129.3–4"), (5, 5, "RV 10.129.5")]
    assert first[0].text == "[RV 10.129.1] verse 1\n\n[RV 10.129.2] verse 2"
    assert {r.doc_id for r in rows} == {1, 2}
    assert len({r.chunk_id for r in rows}) == len(rows)


def _bm25(query, rows):
    from lipika.functions.fixed import EXPANSIONS

    toks = {i: tokenize(f"{t}\n{t}\n{x}" if t else x) for i, t, x in rows}
    df = Counter(w for v in toks.values() for w in set(v))
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    out = {}
    for i, v in toks.items():
        tf, s = Counter(v), 0.0
        for w in tokenize(query):
            w = next((a for a in [w, *EXPANSIONS.get(w, [])] if a in tf), None)
            if w:
                s += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * max(len(v), 1) / avg))
        if s > 0:
            out[i] = round(s, 6)
    return out


def test_bm25_brute_force(spark, tmp_path):
    """Over tokens, in one pass over the texts, and from stored postings."""
    rows = [("a", "Agni", "fire fire burns"), ("b", None, "duty and action"), ("c", "", None), ("d", "Karma", "karma karma work"), ("e", None, "")]
    df = spark.createDataFrame([(i, t, None, None, None, x) for i, t, x in rows], "chunk_id string, title string, work string, locator string, heading string, text string").withColumn("term", F.lit("clash"))
    asked = {"1": "agni agni duty", "2": "karma dharma", "3": ""}
    terms = lexical.query_terms(spark, asked)
    lexical.write_postings(df, str(tmp_path))
    for scores in (lexical.bm25(lexical.with_tokens(df), terms), lexical.bm25(lexical.with_hits(df, terms), terms), lexical.bm25_stored(spark, str(tmp_path), terms)):
        got = scores.collect()
        for q, text in asked.items():
            assert {r.chunk_id: r.score for r in got if r.query_id == q} == _bm25(text, rows)
    assert "bucket" in lexical.bm25_stored(spark, str(tmp_path), terms)._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    for empty in (lexical.with_tokens(df.where("false")), lexical.with_hits(df.where("false"), terms)):
        assert lexical.bm25(empty, terms).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 8))
    rows = [(f"c{i:02d}", "m", [float(v) for v in r], i) for i, r in enumerate(x)] + [("c00", "m", [9.0] * 8, -1), ("n", "m", None, 0), ("z", "m", [0.0] * 8, 0), ("s", "m", [1.0], 0), ("q", "m", [float("nan")] * 8, 0), ("o", "old", [1.0] * 8, 0)]
    df = spark.createDataFrame(rows, "chunk_id string, model_name string, embedding array<float>, created_at long")
    cur = vectors.current(df, "m", 8)
    assert cur.count() == 50
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = [f"c{i:02d}" for i in np.argsort(-(u @ u[3]), kind="stable")[:5]]
    assert [r.chunk_id for r in vectors.top_k(cur, list(x[3]), 5).collect()] == want
    assert [r.chunk_id for r in vectors.top_k_batch(cur, {"q": list(x[3])}, 5).orderBy("rank").collect()] == want
    e = vectors.hashing_embedder(16)(["fire and fire", "", "fire"])
    assert e.shape == (3, 16) and abs(float(e[0] @ e[0]) - 1) < 1e-6


def test_ranking(spark):
    hits = spark.createDataFrame([("q", f"c{i}", i // 4, "t", 10.0 - i) for i in range(10)] + [("q", "x", None, "t", 9.5)], "query_id string, chunk_id string, doc_id int, title string, score double")
    got = ranking.diversify(hits, 5).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["c0", "x", "c1", "c4", "c5"]
    lists = spark.createDataFrame([("q", 0, "a", 1), ("q", 0, "b", 2), ("q", 1, "b", 1)], "query_id string, list int, chunk_id string, rank int")
    fused = {r.chunk_id: r.score for r in ranking.reciprocal_rank_fusion(lists).collect()}
    assert fused["b"] == pytest.approx(1 / 62 + 1 / 61) and fused["a"] == pytest.approx(1 / 61)


def test_anchored_windows(spark):
    times = [0, 10, 20, 59, 61, 62, 130, 131]
    df = spark.createDataFrame([(k, t) for k in ("a", "b") for t in times], "user string, s int").select("user", F.timestamp_seconds(F.col("s")).alias("ts"))
    got = ranking.windows_by_first(df, ["user"], "ts", 60, 3).where("user = 'a'").orderBy("ts").collect()
    assert [r.allowed for r in got] == [True, True, True, False, True, True, True, True]
    assert ranking.windows_by_first(df.where("false"), ["user"], "ts", 60, 3).count() == 0


def test_intent():
    i = hybrid.Intent.of
    assert i("Nasadiya hymn 10.125").hymns == ("10.129",)
    assert i("RV 10.90 and 2.47").hymns == ("10.90", "2.47")
    assert i("Nachiketas in the Kaushitaki").works == ("katha-upanishad",)
    assert i("agni fire").deity == "agni" and i("agni in the forest").deity is None
    assert i("").hymns == ()


def test_hybrid_prefers_named_hymn(spark):
    rows = [("a", 1, 1, "Rig Veda selected hymns", None, "about the Nasadiya hymn of creation"), ("b", 2, 2, "Rigveda RV 10.129", "RV 10.129.1", "then was not non-existent"), ("c", 3, 3, "Rigveda RV 10.12", "RV 10.12.1", "heaven and earth"), ("d", 4, 4, "Mahabharata", None, "creation of war")]
    df = spark.createDataFrame([(c, d, o, t, loc, None, None, x) for c, d, o, t, loc, x in rows], "chunk_id string, doc_id long, ord long, title string, locator string, heading string, work string, text string")
    dense = spark.createDataFrame([("d", 0.9, 1), ("a", 0.8, 2)], "chunk_id string, score double, rank int")
    got = hybrid.search(lexical.with_tokens(df), dense, "Nasadiya creation", 4).orderBy("rank").collect()
    assert got[0].chunk_id == "b" and got[0].hymn_boost == 1.45
    a = next(r for r in got if r.chunk_id == "a")
    assert a.demotion == -1.35 and a.hymn_boost == 0.0
    assert "c" not in [r.chunk_id for r in got]
    none = hybrid.search(lexical.with_tokens(df.where("false")), dense.where("false"), "Nasadiya", 4)
    assert none.count() == 0


def test_verses(spark):
    cols = "chunk_id string, doc_id long, chunk_index int, verse_id string, work string, book int, hymn int, verse int, verse_end int, title string, language string, locator string, text string"
    rows = [
        ("a", 1, 0, "RV.1.1.1", "rigveda", 1, 1, 1, 2, "t", "sa", "RV 1.1.1–2", "[RV 1.1.1] अग्निमी॑ळे । पुरोहितं ॥ [RV 1.1.2] x"),
        ("b", 2, 0, "RV.1.1.2", "rigveda", 1, 1, 2, None, "Griffith", "en", "RV 1.1.2", "worthy"),
        ("c", 3, 0, "YS.1.2", "yoga-sutra", 1, None, 2, 2, "t", None, "YS 1.2", "y"),
        ("d", 4, 0, None, None, None, None, None, None, None, None, None, None),
    ]
    c = spark.createDataFrame(rows, cols).withColumn("asked_x", F.lit(0))
    ask = spark.createDataFrame([("RV.1.1.2",), ("RV.1.1",), ("YS.1.2",), ("bad",), (None,)], "verse_id string")
    got = verses.cover(ask, c)
    assert sorted((r.asked, r.chunk_id, r.exact) for r in got.collect()) == [("RV.1.1", "a", False), ("RV.1.1", "b", False), ("RV.1.1.2", "a", False), ("RV.1.1.2", "b", True), ("YS.1.2", "c", True)]
    bundle = {r.asked: r for r in verses.bundles(got).collect()}
    assert [w.role for w in bundle["RV.1.1.2"].witnesses] == ["sa", "en"] and bundle["RV.1.1.2"].has_sanskrit
    body = c.where("chunk_id = 'a'").select(verses.verse_body(F.col("text"), F.lit("RV.1.1.1"))).first()[0]
    assert body == "अग्निमी॑ळे । पुरोहितं ॥"
    p = spark.createDataFrame([("v", "१॥ अ॑ । आ ॥", "a | ā"), ("w", "", "a b"), ("x", None, None)], "verse_id string, sa string, iast string")
    assert sorted(map(tuple, verses.padas(p).collect())) == [("v", 1, "अ॑", "a"), ("v", 2, "आ", "ā"), ("w", 1, "", "a b")]


def test_catalog_and_status(spark):
    d = docs(spark, {"doc_id": 1, "id": "b", "tradition": "Vedic", "language": "en", "text": "abc", "n_chars": 0}, {"doc_id": 2, "id": "a", "tradition": None, "language": "", "text": None, "n_chars": None}, {"doc_id": 3, "id": "a", "tradition": "vedic", "language": "EN", "text": "Ocean", "n_chars": 7})
    s = {(r.facet, r.value): (r.documents, r.characters) for r in catalog.stats(d).collect()}
    assert s == {("all", ""): (3, 10), ("tradition", "vedic"): (2, 10), ("tradition", "unknown"): (1, 0), ("language", "en"): (2, 10), ("language", "und"): (1, 0)}
    assert [r.doc_id for r in catalog.matching(d, language="En", q="OCEAN").collect()] == [3]
    assert catalog.lookup(d, "a").first().doc_id == 2
    assert {r.tradition: r.documents for r in catalog.tradition_table(d).collect()}["vedic"] == 2
    assert catalog.stats(d.where("false")).count() == 0
    assert status.stored_fingerprint(d.where("false")).first()[0] == "" == status.corpus_fingerprint(d.where("false")).first()[0]
    assert status.stored_fingerprint(d).first()[0] == hashlib.sha256("\n".join(sorted(f"{i}|{hashlib.sha256(t.encode()).hexdigest()}" for i, t in (("b", "abc"), ("a", ""), ("a", "ocean")))).encode()).hexdigest()
    assert status.corpus_fingerprint(d).first()[0] == status.corpus_fingerprint(d.orderBy(F.desc("doc_id"))).first()[0]
    assert {r.check: r.failures for r in status.expectations(d).collect()}["text missing"] == 1
    p = {r.profile: r.ok for r in status.matching_profiles(status.summary(d), {"a": {"min_documents": 4}, "b": {"expected_documents": 3}}).collect()}
    assert p == {"a": False, "b": True}


def test_records(spark):
    src = spark.createDataFrame([("t", "http://x", "Vedic", "", "CC0", None, "body"), ("t", "", None, None, "cc0", True, "b"), ("t", "u", None, None, None, True, None), ("t", "u", None, None, "gpl", True, "b"), ("t", "u", None, None, "cc0", False, "b")], "title string, url string, tradition string, language string, license string, download boolean, text string")
    assert [r.reason for r in records.gate(src).collect()] == ["ok", "url missing", "license missing", "license not allowed", "catalogue only"]
    r = records.build_records(src, retrieved_at=F.lit("")).first()
    assert (r.tradition, r.language, r.license, r.char_count) == ("vedic", "und", "cc0", 4)
    assert records.long_enough(src, 2).count() == 1
    turns = spark.createDataFrame([(1, i, "user" if i % 2 else "system", f"m{i}") for i in range(12)] + [(1, 12, "user", "  ")], "conv_id int, turn int, role string, text string")
    assert [x.turn for x in records.chat_messages(turns).orderBy("turn").collect()] == [5, 7, 9, 11]
    hits = spark.createDataFrame([("q", i, f"L{i}", "T", "x" * 30) for i in (1, 2, 3)], "query_id string, rank int, locator string, title string, text string")
    assert records.context_blocks(hits, 85).count() == 2 and records.context_blocks(hits, 5).count() == 1
    assert records.answers(hits, 2).first()[0].startswith("L1 — T: xxx")


def test_evaluation(spark):
    gold = spark.createDataFrame([("a", 1, ["Ocean"]), ("b", 2, ["x"]), ("c", 1, None)], "id string, min_hits int, expect_title_any array<string>")
    hits = spark.createDataFrame([("a", "the OCEAN"), ("b", "x"), ("c", None)], "query_id string, title string")
    s = evaluation.suite(gold, hits)
    assert {r.id: (r.hits, r.ok) for r in s.collect()} == {"a": (1, True), "b": (1, False), "c": (0, False)}
    assert tuple(evaluation.pass_rate(s).first()) == (1, 3, pytest.approx(1 / 3))
    assert evaluation.pass_rate(s.where("false")).first().rate == 0.0
    other = spark.createDataFrame([("a", False), ("d", True)], "id string, ok boolean")
    assert {r.id: r.change for r in evaluation.compare(s, other).collect()} == {"a": "lost", "b": "only left", "c": "only left", "d": "only right"}
    ids = spark.createDataFrame([(f"q{i}",) for i in range(10)] + [("nasadiya",), ("q1",), (None,)], "query_id string")
    held = sorted(r.query_id for r in evaluation.splits(ids).where("split = 'eval'").collect())
    assert held == ["q8", "q9"]
    rows = [("nasadiya", "Nasadiya", i, t, None, None, "x", ["10.129"], "train") for i, t in enumerate(["RV 10.129", "RV 10.125", *["other"] * 10, "RV 10.5"])]
    h = spark.createDataFrame(rows, "query_id string, query string, rank int, title string, locator string, heading string, text string, expect_title_any array<string>, split string")
    p = evaluation.pairs(h)
    assert Counter(r.pair_kind for r in p.collect()) == {"positive": 1, "hard_negative": 2, "negative": 8}
    assert {r.split: r.pairs for r in evaluation.pair_summary(p).collect()} == {"train": 11, "all": 11}
    assert evaluation.train_rows(p.withColumn("split", F.lit("eval"))).count() == 11
