"""Neighbours, language, scans, truncation: planted cases and the dirty ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lipika.llm import language, neighbours, queries, scans, truncation
from lipika.tables import table

DATA = "/root/testdata/sf0.01"


def _vectors(spark, n=3000, copies=0):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 64)).astype("float32")
    near = x[: n // 10] + 0.25 * rng.normal(size=(n // 10, 64)).astype("float32")
    x = np.vstack([x, near, np.repeat(x[:1], copies, axis=0)])
    rows = [(f"{i:024x}" if i % 3 else f"id-{i}", "mini-multi-64", [float(v) for v in r], i) for i, r in enumerate(x)]
    rows += [("old", "other", [1.0] * 64, 0), ("null", "mini-multi-64", None, 0), ("zero", "mini-multi-64", [0.0] * 64, 0), ("short", "mini-multi-64", [1.0] * 5, 0), ("nan", "mini-multi-64", [float("nan")] * 64, 0), (rows[0][0], "mini-multi-64", [float(v) for v in -x[0]], -5), (None, "mini-multi-64", [1.0] * 64, 0)]
    return spark.createDataFrame(rows, "chunk_id string, model_name string, embedding array<float>, at long").withColumn("created_at", F.timestamp_seconds("at")).withColumn("part", F.lit(0))


def test_forest_recall(spark):
    df = _vectors(spark)
    vectors = neighbours.current_vectors(df)
    assert vectors.count() == 3300
    near = neighbours.neighbours(vectors, neighbours.plant(vectors, candidates=2_000))
    r = neighbours.recall(near, neighbours.all_neighbours(vectors, vectors, least=0.9)).first()
    assert r.expected >= 500 and r.recall >= 0.9
    assert all(x.cosine >= 0.9 and x.id != x.other for x in near.collect())


def test_levels_are_those_of_the_runs():
    """The level is the longest prefix, one for all trees, whose runs hold the candidates: by counting every string."""
    x = np.random.default_rng(2).normal(size=(400, 8)).astype(np.float32)
    x = np.vstack([x, x[:50] + 0.01])
    forest = neighbours.Forest(x, len(x), trees=3, bits=20, candidates=60)
    h = forest.strings(x)
    levels = forest.levels(h)
    for q in range(0, len(x), 7):
        held = [sum(int(((h[:, t] >> (20 - n)) == (h[q, t] >> (20 - n))).sum()) for t in range(3)) for n in range(21)]
        assert levels[q] == max(n for n in range(21) if held[n] >= 60)


def test_runs_cross_the_borders_of_ranges(spark, monkeypatch):
    """With ranges of a few rows every run crosses borders; still every vector finds what its runs hold, or better."""
    vectors = neighbours.current_vectors(_vectors(spark, 1000))
    monkeypatch.setattr(neighbours, "RANGE_ROWS", 120)
    forest = neighbours.plant(vectors, candidates=400)
    assert forest.ranges == 10
    got = neighbours.neighbours(vectors, forest, least=-1.0).toPandas().groupby("id")["cosine"].apply(lambda c: np.sort(c)[::-1])
    rows = vectors.collect()
    x = neighbours._floats(neighbours._vectors([bytes(r.vector) for r in rows]))
    h, s = forest.strings(x), np.round(x @ x.T, 6)
    np.fill_diagonal(s, -2)
    tails = forest.tails(forest.levels(h))
    for i, r in enumerate(rows):
        held = ((h | tails[i]) == (h[i] | tails[i])).any(axis=1)
        want = np.sort(np.where(held, s[i], -2))[::-1][:5]
        assert (got[r.id] >= want - 1e-5).all()


def test_forest_with_many_copies(spark):
    """A third of all rows are one vector: everyone still gets neighbours, and no task holds the pairs."""
    vectors = neighbours.current_vectors(_vectors(spark, 2000, copies=1200))
    kept, copies = neighbours.without_copies(vectors)
    assert kept.count() == 2200 - 1 + 6 and copies.select("id").distinct().count() == 1201 - 6
    of_copies = neighbours.forest_neighbours(vectors).where("cosine > 0.9999").groupBy("id").count().collect()
    assert len(of_copies) == 1201 and all(r["count"] == 5 for r in of_copies)
    assert neighbours.exact_neighbours(vectors, vectors.orderBy("id").limit(50), 5, 0.9).count() > 0


def test_forest_of_nothing(spark):
    vectors = neighbours.current_vectors(_vectors(spark, 100).where("false"))
    assert neighbours.forest_neighbours(vectors).count() == 0 and neighbours.exact_neighbours(vectors).count() == 0
    assert neighbours.recall(neighbours.forest_neighbours(vectors), neighbours.exact_neighbours(vectors)).first().expected == 0


def test_every_chunk_gets_k(spark):
    vectors = neighbours.current_vectors(_vectors(spark, 300))
    counts = neighbours.neighbours(vectors, neighbours.plant(vectors), least=-1.0).groupBy("id").count().collect()
    assert len(counts) == 330 and all(r["count"] == 5 for r in counts)


def _exact(x, k=5):
    """The k most similar others by plain product, ties to the first."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 4)
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1, kind="stable")[:, :k], np.sort(-s, axis=1)[:, :k] * -1


def test_neighbours_query_leaves_no_chunk_out(spark, tmp_path):
    """Chunks without near relatives, and copies, get their 5 as well, and the recall is measured without a cut."""
    df = _vectors(spark, 5000, copies=30)
    df.write.parquet(str(tmp_path / "chunk_embeddings.parquet"))
    near = queries.p5_neighbours(spark, str(tmp_path)).toPandas()
    assert len(near) == 5 * 5530 and not (near["id"] == near["other"]).any() and not near.duplicated(["id", "other"]).any()
    rows = df.where("model_name = 'mini-multi-64' and at >= 0 and size(embedding) = 64 and chunk_id is not null").orderBy("chunk_id", "at").toPandas()
    rows = rows[~rows["chunk_id"].isin(["zero", "nan"])].reset_index(drop=True)
    _, cosines = _exact(np.array(rows["embedding"].to_list(), dtype="float64"))
    got = near.sort_values(["id", "rank"])["cosine"].to_numpy().reshape(-1, 5)
    assert sorted(set(near["id"])) == rows["chunk_id"].to_list() and np.abs(got - cosines).max() < 3e-4
    last = {r.least: r for r in queries.p5_recall(spark, str(tmp_path)).collect()}
    assert last[0.9].recall >= 0.9 and last[-1.0].expected > 200


def test_found_pairs_of_a_dense_group(spark, tmp_path):
    """A third of all vectors near copies of one, none equal: the pairs are those of the plain product."""
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(size=(20_000, 64)), rng.normal(size=64) + 0.2 * rng.normal(size=(10_000, 64))]).astype("float32")
    pdf = pd.DataFrame({"chunk_id": [f"{i:024x}" for i in range(len(x))], "model_name": "mini-multi-64", "embedding": list(x), "created_at": pd.Timestamp("2025-01-01")})
    pdf.to_parquet(tmp_path / "chunk_embeddings.parquet", coerce_timestamps="us")
    who, cosines = _exact(x[20_000:].astype("float64"))
    of = [{int(j) for j, c in zip(w, cs) if c >= 0.9} for w, cs in zip(who, cosines)]
    want = {(i, j) for i, js in enumerate(of) for j in js if i < j and i in of[j]}
    got = {(int(a, 16) - 20_000, int(b, 16) - 20_000) for a, b in queries.p5_found(spark, str(tmp_path)).collect()}
    assert len(want) > 5_000 and len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.97 * len(got)


@pytest.fixture(scope="module")
def profiles(spark):
    return language.learn(table(spark, DATA, "documents", "doc_id", "language", "text"))


def test_languages_learnt(profiles):
    assert {"en", "sa", "hi", "bn", "de", "pt"} == set(profiles.languages)
    assert profiles.languages.count("sa") == 2


def test_held_out_accuracy(spark, profiles):
    """Documents outside the sample table, all of one language by script or by label, get it."""
    docs = table(spark, "/root/testdata/sf0.001", "documents", "doc_id", "language", "text").where("language in ('en', 'de', 'pt', 'bn', 'hi', 'sa')")
    got = language.documents(language.segments(docs, profiles)).where("share > 0.9").collect()
    right = sum(r.language == r.label for r in got)
    assert len(got) > 30 and right >= 0.85 * len(got)  # some labels are wrong by design


def test_segments(spark, profiles):
    rows = [
        (1, "en", "The silent river protects every village.\nवेदः सत्यम् धर्मः रक्षति देवस्य नित्यम् ।\nEvery golden star sings to the mountain."),
        (2, None, "Die heilige Wolke verlässt den Altar.\nJede alte Flamme singt ein Vers."),
        (3, "und", None), (4, "en", ""), (5, "en_Latn", "12 34\n--"), (6, "pt", "Ｔｈｅ ｓｉｌｅｎｔ ｒｉｖｅｒ ｐｒｏｔｅｃｔｓ ｅｖｅｒｙ ｖｉｌｌａｇｅ."),
        (1, "en", "The silent river protects every village."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, language string, text string").withColumn("label", F.lit(0))
    parts = language.segments(df, profiles)
    first = [(r.first_line, r.last_line, r.language) for r in parts.where("doc_id = 1").orderBy("segment_no").collect()]
    assert (2, 2, "sa") in first and (3, 3, "en") in first
    assert all(0 <= r.confidence <= 1 for r in parts.collect())
    found = sorted(map(tuple, language.unnamed(parts).collect()))
    assert (2, "de") in found and (6, "en") in found and (1, "sa") in found and not [x for x in found if x[0] in (3, 4, 5)]
    assert language.unnamed(language.segments(df.where("false"), profiles)).count() == 0
    assert language.learn(df.where("false")).segments("anything at all") is not None


def test_page_lines_and_breaks():
    text = ["and the sea-", "son of every world-", "bearing ocean. (see", "11.30).", "- 132 -", "THE SONG OF THE SEA   15", "xxiii", "It sings aga\xad", "", "[49]", "in. 420", "LAST UPDATED ON 9 JUNE 2011", "It sings.", "Pagc 12"]
    skip = scans.page_lines(text)
    assert {text[i] for i in skip} == {"- 132 -", "THE SONG OF THE SEA   15", "xxiii", "[49]", "Pagc 12"}
    assert [(i, j, a, b) for i, j, a, b in scans.broken_words(text, skip)] == [(0, 1, "sea", "son"), (1, 2, "world", "bearing"), (7, 10, "aga", "in")]


def test_edits():
    assert "golden" in scans.edits("golclen", 9) and "this" in scans.edits("thi5", 9) and "mächtige" in scans.edits("rnächtige", 9) and "when" in scans.edits("wheri", 9)
    assert scans.edits("m" * 40, 9) == [] and len(scans.edits("rnrnrnrn" * 12, 100)) > 400


def test_skip_grams_know_their_contexts():
    """Two words with contexts of their own: products follow the pairs."""
    pairs = np.array([[50, 50, 0, 0], [0, 0, 50, 50], [10, 10, 10, 10]], dtype=np.float32)
    u, v = scans.skip_grams(pairs, steps=200)
    s = u @ v.T
    assert s[0, :2].min() > s[0, 2:].max() + 2 and s[1, 2:].min() > s[1, :2].max() + 2 and np.ptp(s[2]) < 1


def _ambiguous(spark):
    """`c0ve` may be `cove` or `eove`, both established; only the words around tell which stood there."""
    rng = np.random.default_rng(3)
    sea, land = "salt wave shore tide".split(), "plough field barn grain".split()
    line = lambda word, around: " ".join([*rng.choice(around, 2), word, *rng.choice(around, 2)])
    plain = lambda word, around, n: "\n".join(line(word, around) for _ in range(n))
    rows = [(i, "plain", plain("cove", sea, 10) + "\n" + plain("eove", land, 10)) for i in range(60)]
    rows += [(500 + i, "scan", plain("cove", sea, 10) + "\n- 12 -\n" + plain("eove", land, 10) + "\n" + line("c0ve", sea) + "\n" + line("c0ve", land)) for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_the_words_around_decide(spark, monkeypatch):
    df = _ambiguous(spark)
    at = lambda: {(n, c) for _, n, _, c in map(tuple, scans.noise(df)[2].collect())}
    assert at() == {(22, "cove"), (23, "eove")}
    monkeypatch.setattr(scans, "skip_grams", lambda pairs: (np.zeros((len(pairs), 4), np.float32), np.zeros((pairs.shape[1], 4), np.float32)))
    assert len({c for _, c in at()}) == 1  # without vectors one word is taken everywhere


def test_context_counts_towards_the_evidence():
    """A correction that count and letters alone don't justify comes through by its context, and one that they do fails."""
    words, contexts = np.array([[0.0], [4.0]], np.float32), np.array([[2.0], [-2.0]], np.float32)
    reader = scans.Reader({}, ["near", "barn"], words, contexts, np.array([1e6, 1e6]))
    assert reader.best("bam", 0, [("barn", 6)], ["near"])[0] == "barn" and reader.best("bam", 0, [("barn", 6)], []) is None
    assert reader.best("bam", 0, [("barn", 80)], [])[0] == "barn" and reader.best("bam", 0, [("barn", 80)], ["barn"]) is None
    assert reader.best("ba1m", 0, [], []) == (None, 6.0)


def test_misreadings_in_clean_sources_are_no_words(spark):
    rows = [(i, "plain", "the golden star sings " * 50) for i in range(40)] + [(100, "plain", "golclen"), (101, "plain", "golclen")]
    rows += [(500 + i, "scan", "the golclen star sings\n- 12 -\nthe star sings") for i in range(20)]
    counts, _ = scans.word_counts(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    known = {r.word: r.known for r in counts.collect()}
    assert known["golden"] and not known["golclen"]


def test_a_scan_among_other_texts_is_repaired(spark):
    """One document in a hundred of its source has pages: it is a scan all the same."""
    page = "It sings to every sea-\nson.\n- 12 -\nThe end of it."
    df = spark.createDataFrame([(i, "mixed", "It sings.\nThe end of every season.") for i in range(200)] + [(900, "mixed", page)], "doc_id long, source string, text string")
    assert {r.doc_id: r.text for r in scans.repaired(df).collect()} == {900: "It sings to every season. The end of it."}


def _scanned(spark):
    rng = np.random.default_rng(1)
    words = "season golden mountain silent river ancient teacher wisdom offering village chant memory world star heart thunder".split()
    sentence = lambda: " ".join(rng.choice(words, 8)).capitalize() + "."
    rows = [(i, "plain", "\n".join(sentence() for _ in range(12)) + "\nworld-bearing star.") for i in range(120)]
    page = "The golclen mountain of every sea-\nson sings to the world-\nbearing star.\n- 12 -\nThi5 silent river flows over anci\xad\nent stones."
    rows += [(1000 + i, "scan", sentence() + "\n" + page) for i in range(10)] + [(2000, None, page), (2001, None, "A golclen star."), (2002, "scan", None), (2003, "scan", "")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("word", F.lit("clash"))


def test_scans(spark):
    df = _scanned(spark)
    rows = [tuple(r) for r in scans.noisy_lines(df).where("doc_id >= 1000").collect()]
    of = lambda d, shift: {(n - shift, k) for i, n, k in rows if i == d}
    want = {(1, "break"), (4, "page"), (1, "glyph"), (5, "break")}
    assert want <= of(1000, 1) and want <= of(2000, 0)
    assert (2, "break") not in of(1000, 1)
    assert not of(2001, 0) and not of(2002, 0) and not of(2003, 0)
    fixed = {r.doc_id: r.text for r in scans.repaired(df).where("doc_id in (1000, 2003)").collect()}
    assert "golden mountain of every season sings to the world-bearing star." in fixed[1000]
    assert "- 12 -" not in fixed[1000] and "ancient stones" in fixed[1000]
    assert fixed[2003] == ""
    assert scans.noisy_lines(df.where("false")).count() == 0


def test_scans_without_source_are_repaired(spark):
    df = _scanned(spark)
    fixed = {r.doc_id: r.text for r in scans.repaired(df).where("doc_id >= 2000").collect()}
    assert 2000 in fixed and "golden mountain of every season sings to the world-bearing star." in fixed[2000]
    assert "- 12 -" not in fixed[2000] and "ancient stones" in fixed[2000]
    unsaid = {r.doc_id for r in df.where("source is null").collect()}
    assert unsaid & set(fixed) == {2000}


def test_length_fit():
    rng = np.random.default_rng(2)
    x = np.exp(rng.normal(6.5, 0.6, 4000)).astype(int) + 1
    x = np.minimum(x, 1000)
    lengths, counts = np.unique(x, return_counts=True)
    post = truncation.fit_lengths(lengths.tolist(), counts.tolist())
    assert post[1000] > 0.9
    assert max((v for k, v in post.items() if k != 1000), default=0) < 0.9
    assert truncation.fit_lengths([5], [1]) == {}


def test_truncation(spark):
    whole = ["Every star sings.", "वेदः रक्षति ॥५॥", "He said “no.”", "vedaḥ // 3 //"]
    rows = [(i, "s", None, f"A first line that is unique {i}.\n{whole[i % 4]}\nRead more pages like this one here\nand {i} again.") for i in range(40)]
    cut = {100: "The river runs over every golden mou", 101: "It sings…", 102: "It sings [...]", 103: "It sin�", 104: "नदी पर्वत", 105: "It sings ...", 106: "The river runs over\n\n- 12 -"}
    fine = {200: "All is well.", 201: "It ends.\nRead more pages like this one here", 202: "It ends.\nREAD MORE PAGES LIKE THIS ONE HERE\n\n", 206: "It ends.\n[12]\n", 203: None, 204: "", 205: "  \n "}
    rows += [(i, "s", None, t) for i, t in {**cut, **fine}.items()] + [(100, "s", None, cut[100])]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_chars long, text string").withColumn("state", F.lit("clash"))
    j = truncation.judged(df)
    assert {r.doc_id for r in j.where("truncated").collect()} == set(cut)
    r = truncation.rates(j).first()
    assert r.truncated == len(cut) + 1 and 0 < r.rate < 1
    assert truncation.judged(df.where("false")).count() == 0


def _texts(rng, n, closing):
    words = [f"word{k}" for k in range(400)]
    return [" ".join(rng.choice(words, rng.integers(20, 400))) + closing for _ in range(n)]


def test_the_posterior_turns_verdicts(spark):
    """In a source that ends openly by habit only values at the limit are cut; in another every open ending is."""
    rng = np.random.default_rng(5)
    rows = [(i, "bare", t) for i, t in enumerate(_texts(rng, 400, "")) if len(t) != 900]
    rows += [(1000 + i, "bare", (t * 3)[:900].rstrip() + "x" * (900 - len((t * 3)[:900].rstrip()))) for i, t in enumerate(_texts(rng, 40, " "))]
    rows += [(2000 + i, "tidy", t) for i, t in enumerate(_texts(rng, 400, "."))] + [(3000 + i, "tidy", t) for i, t in enumerate(_texts(rng, 12, ""))]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("n_chars", F.lit(None).cast("long"))
    cut = lambda: {r.doc_id for r in truncation.judged(df).where("truncated").collect()}
    found = cut()
    assert {i for i in found if i < 2000} == set(range(1000, 1040)) and {i for i in found if i >= 2000} == set(range(3000, 3012))
    fit = truncation.fit_lengths
    truncation.fit_lengths = lambda lengths, counts: {}  # without the lengths' model no value of the first source is found
    try:
        assert cut() == set(range(3000, 3012))
    finally:
        truncation.fit_lengths = fit


def test_a_closed_ending_at_an_overfull_limit():
    e = truncation.Endings.prior()
    closed = np.array([truncation.STATES.index("closed")])
    assert e.odds(np.array([0.5]), closed, np.array([0]))[0] < 1 < e.odds(np.array([0.999]), closed, np.array([0]))[0]


def test_more_values_do_not_turn_cuts_into_style():
    """Values at lengths wrongly taken for limits are a misfit that grows with the values; marks and open ends stay cut."""
    at = {s: truncation.STATES.index(s) for s in truncation.STATES}
    state = np.array([at["open"], at["marked"], at["closed"], at["closed"], at["known"]])
    censored, more = np.array([0.0, 0.0, 0.0, 0.2, 0.0]), np.zeros(5, dtype=np.int64)
    for size in (1, 50, 1000):
        n = size * np.array([30.0, 60.0, 6000.0, 300.0, 4000.0])
        odds = truncation.Endings.fit(truncation.Endings.prior(), censored, state, more, n).odds(censored, state, more)
        assert odds[0] > 1 and odds[1] > 1 and max(odds[2:]) < 1


def test_a_misfit_of_the_density_is_no_limit():
    x = np.arange(200, 4000)
    n = 1e6 * (np.exp(-(((x - 600) / 150) ** 2)) + np.exp(-(((x - 1900) / 300) ** 2)))
    n = (n / n.sum() * 1e6).astype(int) + 1
    n[x == 1000] += 5000
    found = truncation.fit_lengths(x.tolist(), n.tolist())
    assert found[1000] > 0.8 and max(v for k, v in found.items() if k != 1000) < 0.25


def test_frames_met_by_chance_are_not_known():
    counts = {(0, 0): 1000, (0, 1): 90, (0, 3): 45, (0, 9): 50, (3, 0): 9000, (3, 1): 850, (3, 3): 90, (3, 9): 9}
    assert truncation.known_levels(counts) == [3, 9]
    assert truncation.known_levels({}) == [] and truncation.known_levels({(0, 0): 3, (0, 5): 2, (3, 0): 45}) == [5]
