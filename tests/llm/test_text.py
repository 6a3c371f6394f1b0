"""Tokens, canonical form, lines, splitting: brute force, round trips, and the dirty cases."""

import base64
import random
import unicodedata
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lipika.llm import canonical, lines, queries, splitting, tokens

VOCAB = ["a", "ab", "abc", "b", "the", "##c", "##bc", "##the", "##a", "##", "é"]


def brute(text):
    """Tokens by plain greedy longest prefix."""
    heads, tails = {p for p in VOCAB if not p.startswith("##")}, {p[2:] for p in VOCAB if p.startswith("##") and len(p) > 2}
    total = 0
    for w in (text or "").lower().split():
        i = 0
        while i < len(w):
            among = tails if i else heads
            i += next((n for n in range(len(w) - i, 0, -1) if w[i : i + n] in among), 1)
            total += 1
    return total


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcthe é\n　x", max_size=40))
def test_pieces_are_greedy(t):
    assert tokens.Pieces(VOCAB).count(t) == brute(t)


def test_word_split_is_unicode_white_space():
    assert tokens.Pieces(["a"]).count("a\x1ca") == 3  # U+001C is no White_Space
    assert tokens.Pieces(["a"]).count("a\x85a a") == 3


def test_merges_equal_a_public_tokenizer():
    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    by_text = {k.decode("latin-1"): v for k, v in ranks.items()}
    for word in (" liberation", " aaaaaaaa", "ātman", " sutra-folio", "नमामि", "x"):
        got = tokens.merge_symbols(list(word.encode().decode("latin-1")), by_text)
        assert [by_text[x] for x in got] == enc.encode_ordinary(word) or len(enc._pat_str) == 0
    assert tokens.merge_symbols([], by_text) == []


def test_slices_roll_up(spark):
    rows = [("s", "en", "Vedic ", "a abc"), ("s ", "EN-in", "vedic", "abc abc x"), (None, "", None, None), ("", "und", "unknown", ""), ("s", "en", "vedic", "a abc")]
    df = spark.createDataFrame(rows, "source string, language string, tradition string, text string").withColumn("tokens", F.lit(1)).withColumn("documents", F.lit(1))
    got = {(r.source, r.language, r.tradition): (r.documents, r.tokens) for r in tokens.slice_tokens(df, tokens.Pieces(VOCAB)).collect()}
    assert got == {("s", "en", "vedic"): (3, brute("a abc") * 2 + brute("abc abc x")), ("unknown", "und", "unknown"): (2, 0)}
    assert tokens.slice_tokens(df.where("false"), tokens.Pieces(VOCAB)).count() == 0


PAIRS = [("dawn", "dａｗn"), ("café", "café"), ("a b", "a b"), ("a b", "a　b"), ("silent", "si​le­nt"), ("The", "Τhе"), ("ड़", "ड़"), ("fire", "ﬁre"), ("well-known", "well‐known"), ("q̣̄", "q̣̄"), ("Mocква", "Москва"), ("𝐝awn", "dawn"), ("հello", "hello"), ("ᎢHE", "THE"), ("si\u200clent", "silent"), ("Это cop", "Это сор")]


@pytest.mark.parametrize(("a", "b"), PAIRS)
def test_same_look(a, b):
    assert canonical.canonical_text(a) == canonical.canonical_text(b)


@pytest.mark.parametrize(("a", "b"), [("Schuler", "Schüler"), ("x2", "x²"), ("a  b", "a b"), ("ſo", "so"), ("A", "a"), ("478", "178"), ("a\nb", "a b"), ("श", "ष"), ("क्\u200dष", "क्ष"), ("क्\u200cष", "क्ष"), ("می\u200cخواهم", "میخواهم")])
def test_other_look(a, b):
    assert canonical.canonical_text(a) != canonical.canonical_text(b)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_form_is_whole_normalisation(t):
    """Splicing segments equals folding and normalising the whole text, and is stable."""
    fold = canonical._tables()[0]
    form = canonical.canonical_text(t)
    assert canonical.canonical_text(form) == form
    if t.isascii():
        assert form == t
    assert unicodedata.is_normalized("NFC", form) or any(unicodedata.combining(c) for c in form) or any(0xAC00 <= ord(c) <= 0xD7A3 or 0x1100 <= ord(c) <= 0x11FF for c in form)
    assert not any(fold.get(ord(c), c) != c and ord(c) in fold for c in form)


@pytest.mark.parametrize("t", ["Москва и Это", "ὁ λόγος", "Երևան", "ᏣᎳᎩ", "क्\u200dष"])
def test_own_scripts_stay(t):
    assert canonical.canonical_text(t) == t


def test_lookalike_pairs(spark):
    rows = [(1, "dawn"), (2, "dａwn"), (3, "dawn"), (4, "dusk"), (5, None), (6, ""), (7, ""), (2, "dａwn"), (8, "d​awn")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit("clash"))
    got = sorted(map(tuple, canonical.lookalike_pairs(df, "doc_id", "text").collect()))
    assert got == [("1", "2"), ("1", "8"), ("2", "3"), ("2", "8"), ("3", "8")]
    assert canonical.lookalike_pairs(df.where("false"), "doc_id", "text").count() == 0
    members = {r.item: (r.representative, r.first, r.variants, r.members, r.links) for r in canonical.look_members(df, "doc_id", "text").collect()}
    assert members == {"1": ("1", "1", 3, 4, 2), "3": ("1", "1", 3, 4, 2), "2": ("2", "1", 3, 4, 3), "8": ("8", "1", 3, 4, 3)}


def test_a_large_class_is_linear(spark):
    """10 000 rows of two texts: every row is linked to the other text, and no more rows come out than went in."""
    df = spark.range(10_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "dawn").otherwise("dａwn").alias("text"))
    pairs = canonical.lookalike_pairs(df, "doc_id", "text")
    assert pairs.count() == 9_999
    assert pairs.select("item_a").union(pairs.select("item_b")).distinct().count() == 10_000
    assert canonical.look_members(df, "doc_id", "text").count() == 10_000


def test_canonical_query_covers_documents_and_chunks(spark, tmp_path):
    spark.createDataFrame([(1, "dawn"), (2, "dａwn"), (3, None), (4, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("c1", "si​lent"), ("c1", "si​lent"), ("c2", "silent"), ("c3", None), ("2", "a　b")], "chunk_id string, text string").write.parquet(str(tmp_path / "chunks.parquet"))
    got = queries.p3_canonical(spark, str(tmp_path))
    assert got.columns == ["item_kind", "item_id", "canonical_text"]
    assert sorted(map(tuple, got.collect())) == [("chunk", "2", "a b"), ("chunk", "c1", "silent"), ("document", "2", "dawn")]


def _line_docs():
    rng = random.Random(3)
    rows = []
    for i in range(60):
        site = rng.choice(["a.org", "www.a.org:80", "A.org", "b.org", None])
        body = [f"a line of its own number {i} and {rng.random()}" for _ in range(rng.randrange(4))]
        if rng.random() < 0.5:
            body += [f"  Visited {i}  TIMES since the beginning ", f"visited {i} times since the beginning"]
        rows.append((i, f"https://{site}/p{i}" if site else rng.choice([None, ""]), "\n".join(body) if rng.random() < 0.95 else None))
    return rows


def _repeated(rows):
    import re

    form = lambda x: re.sub("[0-9]+", "#", " ".join(x.split()).lower())
    site = lambda u: re.sub(r"^www\.", "", re.sub(r"^https?://([^/:]*).*$", r"\1", u.lower())) if u else None
    docs, counts, found = Counter(site(u) for _, u, _ in rows if u), defaultdict(set), []
    for i, u, t in rows:
        for x in (t or "").split("\n") if u and t is not None else []:
            if len(form(x)) >= 20:
                counts[site(u), form(x)].add(i)
    for i, u, t in rows:
        for k, x in enumerate((t or "").split("\n") if u and t is not None else [], 1):
            n = len(counts.get((site(u), form(x)), ()))
            if n >= 5 and n >= 0.1 * docs[site(u)]:
                found.append((i, k))
    return sorted(found)


def test_repeated_lines_and_increments(spark, tmp_path):
    rows = _line_docs()
    df = spark.createDataFrame(rows, "doc_id long, source_url string, text string").withColumn("site", F.lit("clash"))
    keyed = lines.keyed(df)
    whole = lines.LineCounts()
    over = whole.add(df, keyed)
    found = sorted(map(tuple, lines.repeated_lines(keyed, over).collect()))
    assert found == _repeated(rows) and found
    for n in (2, 3):
        split = [df.where(F.col("doc_id") % n == k) for k in range(n)]
        assert sorted(map(tuple, lines.grown(*split).collect())) == sorted(map(tuple, lines.rebuild(df, keyed, over).collect()))
    parts = lines.LineCounts()
    for n in range(3):
        part = df.where(F.col("doc_id") % 3 == n)
        parts.add(part, lines.keyed(part))
    assert sorted(map(tuple, parts.over.collect())) == sorted(map(tuple, over.collect()))
    folder = str(tmp_path / "state")
    whole.save(folder)
    loaded = lines.LineCounts.load(spark, folder)
    assert loaded.add(df.where("false"), lines.keyed(df.where("false"))).count() == 0
    assert sorted(map(tuple, loaded.over.collect())) == sorted(map(tuple, over.collect()))
    rebuilt = {r.doc_id: r for r in lines.rebuild(df, keyed, over).collect()}
    text = {i: t for i, _, t in rows}
    gone = defaultdict(set)
    for i, k in found:
        gone[i].add(k)
    assert {i: r.text for i, r in rebuilt.items()} == {i: "\n".join(x for k, x in enumerate(text[i].split("\n"), 1) if k not in g) for i, g in gone.items()}
    empty = df.where("false")
    assert lines.LineCounts().add(empty, lines.keyed(empty)).count() == 0


def test_incremental_query_reaches_the_cleaned_state(spark, tmp_path):
    """Lines over from the start, crossing late and falling late; late documents lose lines that were over before."""
    always, late, falling = "a line that is on all of the pages", "a line that comes with the later ones", "a line that only a few old pages bear"
    rows = []
    for i in range(60):
        new = i >= 20
        body = [f"a line of its own number {'x' * i}", always, *[late] * (i % 2 if new else i == 0), *[falling] * (i < 5)]
        rows.append((i, "https://a.org/p" if i != 7 else None, "\n".join(body), "2025-03-01 00:00:00" if new else ("2024-03-01 00:00:00" if i % 3 else None)))
    # on a second site all there is falls under the threshold again
    rows += [(100 + i, "https://b.org/p", falling if i < 5 else f"nothing {i}", "2025-03-01 00:00:00" if i >= 10 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, source_url string, text string, retrieved_at string").withColumn("retrieved_at", F.to_timestamp("retrieved_at"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got, whole = (sorted(map(tuple, q(spark, str(tmp_path)).select("doc_id", "text", "removed").collect())) for q in (queries.p4_incremental, queries.p4_cleaned))
    assert got == whole
    removed = {i: n for i, _, n in got}
    assert len(removed) == 59 and removed[0] == 2 and removed[1] == 1 and removed[21] == 2 and removed[22] == 1


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .\n।अ", max_size=900), st.integers(20, 200))
def test_pieces_cover_and_fit(t, limit):
    spans = splitting.split_text(t, limit, limit // 6)
    body = t.strip()
    assert bool(spans) == bool(body)
    assert all(len(t[a:b].strip()) <= limit for a, b in spans)
    if spans:
        first, last = len(t) - len(t.lstrip()), len(t.rstrip())
        assert spans[0][0] == first and spans[-1][1] == last
        assert all(c <= b and c > a for (a, b), (c, _) in zip(spans, spans[1:]))


def test_word_cuts_fall_into_the_valley():
    """Text on one line is cut where its words change, at the end of a sentence if there is one."""
    old, new = "river stone water bank ", "planet star comet moon "
    t = old * 26 + new * 40
    assert splitting.split_text(t, 800, 0)[0] == (0, len(old * 26))
    t = old * 20 + "river stone. " + old * 8 + new * 40
    assert t[: splitting.split_text(t, 800, 0)[0][1]].endswith("stone. ")


def test_prose_on_one_line_ends_at_sentences():
    rng = random.Random(4)
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    text = " ".join(" ".join(rng.choice(words) for _ in range(rng.randrange(6, 18))).capitalize() + rng.choice([".", "?", ".”"]) for _ in range(200))
    cuts = splitting.cut_text(text, 800, 100)
    assert len(cuts) > 20 and {c[2] for c in cuts[:-1]} == {"sentence"} and cuts[-1][2] == "end"
    assert all(text[: c[1]].rstrip()[-1] in ".?”" for c in cuts[:-1])


def test_a_deep_valley_goes_before_a_line_end():
    old, new = "river stone water bank ", "planet star comet moon "
    t = old * 25 + "river stone. " + new * 4 + "\n" + new * 40
    assert t[: splitting.split_text(t, 800, 0)[0][1]].endswith("stone. ")
    t = "\n".join(["river stone water bank"] * 60)
    assert {c[2] for c in splitting.cut_text(t, 800, 0)[:-1]} == {"line"}


def test_valleys_are_deeper_at_cuts(spark):
    rng = random.Random(9)
    topics = [[f"{w}{chr(97 + k)}" for k in range(12)] for w in "pqrstuvw"]
    text = "\n".join(" ".join(rng.choice(t) for _ in range(9)) + "." for t in topics for _ in range(9))
    df = spark.createDataFrame([("x", text)], "doc_id string, text string").withColumn("depth", F.lit(0))
    row = splitting.cut_quality(splitting.split_items(df, 800, 0, "doc_id").withColumn("item_kind", F.lit("document")), "item_kind").first()
    assert row.cut == "line" and row.depth > 2 * row.typical


@pytest.mark.parametrize("style", ["[{n}] text of it goes on", "{n}. text of it goes on", "8.{n} text of it goes on", "पाठः सत्यम् धर्मः ॥{n}॥", "pāṭhaḥ satyam // 3.{n} //", "पाठः सत्यम् धर्मः ।।3.{n}।।"])
def test_verses_in_pieces(spark, style):
    text = "\n".join(style.format(n=n) + (" word" * 12 + " (see 12.5)\n827 wanderers" if "text" in style else "") for n in range(5, 60) if n != 30)
    df = spark.createDataFrame([("x", text), ("x", text), ("y", None), ("z", ""), ("s", "1. short")], "chunk_id string, text string").withColumn("start", F.lit(0))
    rows = splitting.split_items(df, 800, 100, "chunk_id").orderBy("piece_no").collect()
    assert {r.item_id for r in rows} == {"x"} and len({r.piece_no for r in rows}) == len(rows)
    assert sorted({n for r in rows for n in r.verses}) == [n for n in range(5, 60) if n != 30]
    assert all(len(r.piece.strip()) <= 800 and r.piece == text[r.start : r.end] for r in rows)
    assert all((r.verse, r.verse_end) == (r.verses[0], r.verses[-1]) for r in rows)


def test_disguised_numbers():
    assert [n for *_, n in splitting.verse_marks("[1​2] a\n[１3]　b\n[14] c")] == [12, 13, 14]
    assert [n for *_, n in splitting.verse_marks("अ ॥ 6３ ॥ आ ॥ ५​9 ॥")] == [63, 59]
