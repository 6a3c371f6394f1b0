"""Expressions against plain Python."""

import hashlib
import re
import unicodedata

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lipika.functions import refs, sanskrit as S, text as T


def one(spark, expr, *values, types="string"):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} {t}" for n, t in zip(names, types.split("|") if "|" in types else [types] * len(names))))
    return df.select(expr(*(F.col(n) for n in names)).alias("x")).first()[0]


def test_fingerprint_and_id(spark):
    raw = "  Straße  und\tWEG \n"
    flat = " ".join(raw.lower().split())
    assert one(spark, T.content_fingerprint, raw) == hashlib.sha256(flat.encode()).hexdigest()
    assert one(spark, lambda a, b, c: T.stable_id(a, b, c), "u", None, "x") == hashlib.sha256(b"u||x").hexdigest()[:24]


@pytest.mark.parametrize(("raw", "want"), [("a\r\nb\rc", "a\nb\nc"), ("a \t b\n\n\n\nc ", "a b\n\nc"), ("", ""), (None, None)])
def test_whitespace(spark, raw, want):
    assert one(spark, T.normalize_whitespace, raw) == want


@pytest.mark.parametrize(("raw", "want"), [("XIV", 14), ("ix", 9), ("12", 12), ("0", None), ("IIII", 4), ("", None), ("abc", None), (None, None), ("MCMXC", 1990)])
def test_numerals(spark, raw, want):
    from lipika.operators.units import number

    assert one(spark, T.int_or_roman, raw) == want
    assert number(raw) == want


def test_devanagari(spark):
    assert one(spark, T.devanagari_int, "१२३") == 123
    assert one(spark, T.devanagari_int, "०") is None
    assert one(spark, T.devanagari_length, "कर्म x") == 4
    assert S.to_iast("आत्मन्") == "ātman"
    assert S.to_iast("कृष्ण ॐ धर्मः।") == "kṛṣṇa om dharmaḥ."
    assert S.to_ascii("kṛṣṇa Ḹ") == "krsna L"
    assert S.fold("Straße क़ Ā") == "strasse क a"
    assert S.tokenize("कर्मण्येवाधिकारस्ते मा फलेषु") == ["करमणयव", "ध", "क", "रसत", "म", "फलष"]
    assert S.spellings("kṛṣṇa") == ["kṛṣṇa", "krsna", "krishna"] or "krsna" in S.spellings("kṛṣṇa")


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_fold_property(t):
    want = "".join(c for c in unicodedata.normalize("NFKD", t) if unicodedata.category(c) != "Mn").casefold()
    assert S.fold(t) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("RV.10.129.1", ("rigveda", 10, 129, 1)), ("rv.1.1", ("rigveda", 1, 1, None)), ("BG.2.p3", ("bhagavad-gita", 2, None, 3)), ("SV.1.2.3.4.5", ("samaveda", 102, 3004, 5)), ("YS.1.2", ("yoga-sutra", 1, None, 2)), ("RV.10", None), ("XX.1.2", None), ("", None), (None, None), ("RV.a.b", None)],
)
def test_parse_verse_id(spark, raw, want):
    got = one(spark, refs.parse_verse_id, raw)
    assert (got and (got.work, got.book, got.hymn, got.verse)) == want


def test_verse_id_and_locator(spark):
    df = spark.createDataFrame([("rigveda", 10, 129, 1, 2), ("samaveda", 102, 3004, 5, 5), ("yoga-sutra", 1, None, 2, None), ("bhagavad-gita", 2, None, None, None)], "w string, b int, h int, v int, e int")
    rows = df.select(refs.verse_id(F.col("w"), F.col("b"), F.col("h"), F.col("v")), refs.locator(F.col("w"), F.col("b"), F.col("h"), F.col("v"), F.col("e"))).collect()
    assert [tuple(r) for r in rows] == [("RV.10.129.1", "RV 10.129.1–2"), ("SV.1.2.3.4.5", "SV 1.2.3.4.5"), ("YS.1.2", "YS 1.2"), ("BG.2", "BG 2")]


@pytest.mark.parametrize(
    ("title", "url", "want"),
    [("Atharva Veda", None, "atharvaveda"), ("VS 12 x", "", "yajurveda"), ("Hymns of the Sama", None, "samaveda"), (None, "https://x/rv10129.htm", "rigveda"), ("Yoga Sutra", None, "yoga-sutra"), ("The Gītā", None, "bhagavad-gita"), ("gitanjali", None, None), (None, None, None)],
)
def test_detect_work(spark, title, url, want):
    assert one(spark, lambda a, b: refs.detect_work(a, b), title, url) == want


def test_small_expressions(spark):
    assert one(spark, T.preview, "x" * 300) == "x" * 279 + "…"
    assert one(spark, lambda a, b: T.citation_label(a, b), " ", "T") == "T"
    assert one(spark, lambda a, b: T.citation_label(a, b), None, "") == "fonte"
    assert one(spark, T.slices, "a" * 100) == ["a" * 48, "a" * 48, "a" * 4]
    assert one(spark, T.slices, None) == []
    assert one(spark, T.url_is_public, "http://127.0.0.1/x") is False
    assert one(spark, T.url_is_public, "https://example.org/x") is True
    assert one(spark, T.strip_ebook_markers, "x\n*** START OF THE PROJECT G ***\nbody\n*** END OF THE PROJECT G ***\n") == "body"
    assert "s3cret" not in one(spark, T.redact_credentials, "postgres://u:s3cret@h/db password=s3cret")
    assert one(spark, T.vector_literal, [0.5, -1.0], types="array<float>") == "[0.50000000,-1.00000000]"
    assert one(spark, T.echo_gap, "abc") == 3200
    assert one(spark, T.safe_name, "RV 10.1/é") == "RV_10.1_"
    assert one(spark, lambda b: refs.hymn_in_blob(b, "10.5"), "RV 10.50") is False
    assert one(spark, lambda b: refs.hymn_in_blob(b, "10.5"), "RV 10.5.1") is True


def test_expand_query_keeps_order():
    got = S.expand_query("karma yoga")
    assert got[0] == "karma yoga"
    assert all(x == x.strip() and x for x in got)
    assert len({x.lower() for x in got}) == len(got)
    assert re.search("action", " ".join(got))


def test_settings(monkeypatch):
    from lipika.settings import bounded, flag

    monkeypatch.setenv("LIPIKA_T", " Yes ")
    assert flag("LIPIKA_T") and not flag("LIPIKA_NONE") and flag("LIPIKA_NONE", True)
    monkeypatch.setenv("LIPIKA_T", "900")
    assert bounded("LIPIKA_T", 5, 1, 100) == 100 and bounded("LIPIKA_T", 5, 1000) == 1000 and bounded("LIPIKA_NONE", 5, 1) == 5


def test_exact_halves_go_to_the_even_digit(spark):
    from lipika.functions import text as T

    values = [0.001953125, 0.005859375, -0.001953125, 0.5, 1e-9]
    got = spark.createDataFrame([(values,)], "v array<float>").select(T.vector_literal(F.col("v"))).first()[0]
    assert got == "[" + ",".join(f"{v:.8f}" for v in values) + "]"
