"""Readers and writers over files made by the tests."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lipika.sources import corpus, files, scripture


def test_jsonl(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('{"id": "a", "text": " x "}\n\n{broken\n{"id": "b", "text": ""}\n', encoding="utf-8")
    assert [r.id for r in corpus.read_corpus(spark, str(p)).orderBy("id").collect()] == ["a", "b"]
    assert [r.text for r in corpus.read_texts(spark, str(p)).collect()] == ["x"]
    assert [r.value for r in corpus.malformed(spark, str(p)).collect()] == ["{broken"]
    assert corpus.read_corpus(spark, str(tmp_path / "none")).count() == 0
    out = str(tmp_path / "out")
    assert corpus.append(corpus.read_corpus(spark, str(p)), out) == 2
    assert corpus.append(corpus.read_corpus(spark, str(p)), out) == 2
    assert corpus.read_corpus(spark, out).count() == 4


def test_rewrite_reads_what_it_replaces(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(10).write.parquet(path)
    corpus.rewrite(spark.read.parquet(path).where("id < 4"), path)
    assert spark.read.parquet(path).count() == 4


@pytest.mark.parametrize("wrap", [lambda x: {"meta": {}, "sources": x}, lambda x: x])
def test_manifest(spark, tmp_path, wrap):
    p = tmp_path / "m.json"
    p.write_text(json.dumps(wrap([{"title": "A", "url": "u", "tags": ["x"], "download": False}, {"title": "B"}])), encoding="utf-8")
    rows = corpus.read_manifest(spark, str(p)).orderBy("ord").collect()
    assert [(r.ord, r.title, r.download) for r in rows] == [(0, "A", False), (1, "B", None)]


def test_gold_candidates_pairs(spark, tmp_path):
    g = tmp_path / "g.json"
    g.write_text(json.dumps({"queries": [{"id": "q", "query": "x", "top_k": 3, "min_hits": 1, "expect_title_any": ["A"]}]}))
    assert corpus.read_gold(spark, str(g)).first().expect_title_any == ["A"]
    a, b = tmp_path / "a.json", tmp_path / "b.json"
    a.write_text(json.dumps({"queries": [{"id": "q", "hits": [{"title": "T", "score": 1.0}, {"title": "U"}]}]}))
    b.write_text(json.dumps({"q": [{"title": "T", "score": 1.0}, {"title": "U"}]}))
    for p in (a, b):
        assert [(r.query_id, r["rank"], r.title) for r in corpus.read_candidates(spark, str(p)).orderBy("rank").collect()] == [("q", 1, "T"), ("q", 2, "U")]
    p = tmp_path / "p.jsonl"
    p.write_text("\n".join(json.dumps(x) for x in ({"query": "q", "text": "t", "label": 1}, {"query": "q", "passage": "t", "label": True}, {"query": "q", "document": "t", "label": "no"}, {"query": "", "text": "t", "label": 1}, {"query": "q", "text": "t", "label": "?"})))
    assert sorted(r.label for r in corpus.read_pairs(spark, str(p)).collect()) == [0.0, 1.0, 1.0]
    assert corpus.read_config(str(tmp_path / "none"), {"a": 1}) == {"a": 1}


def _sheet(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rows = [("Belege", "", "h"), ("b01_h001_01", "b", "s1"), ("b01_h001_01", "a", "s0"), ("b01_h001_01", "a", "late"), ("b01_h001_02", "a", "")]
    strings = ["agnim", "ile"]
    cells = lambda i, r: "".join(f'<c r="{c}{i}" t="s"><v>{v[1:]}</v></c>' if v in ("s0", "s1") else f'<c r="{c}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in zip("ABC", r))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>" + "".join(f'<row r="{i}">{cells(i, r)}</row>' for i, r in enumerate(rows, 1)) + "</sheetData></worksheet>")


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é\r\n\r\n\r\n\r\nx".encode("latin-1"))
    (tmp_path / "b.txt").write_bytes("﻿u".encode("utf-16"))
    (tmp_path / "c.html").write_text("<title>T | X Portal</title><nav>menu</nav><p>One <b>two</b></p><script>x()</script><p>three &amp; four</p>")
    with zipfile.ZipFile(tmp_path / "d.epub", "w") as z:
        z.writestr("2.xhtml", "<p>second</p>")
        z.writestr("1.xhtml", "<p>first</p><style>s</style>")
    (tmp_path / "e.epub").write_bytes(b"no archive")
    (tmp_path / "f.bin").write_bytes(b"x")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.extract(files.scan(spark, str(tmp_path))).collect()}
    assert rows["a.txt"].text == "é\n\nx" and rows["b.txt"].text.strip("﻿") == "u"
    assert rows["c.html"].text == "T | X Portal\nOne two\nthree & four"
    assert rows["d.epub"].text == "first\n\nsecond"
    assert rows["e.epub"].text is None and rows["e.epub"].error
    assert "no reader" in rows["f.bin"].error
    small = files.scan(spark, str(tmp_path), 1)
    assert small.count() == len(rows) and small.where("content is not null").count() == 1
    assert files.extract(small).where("error = 'file too large'").count() == len(rows) - 1
    assert files.html_title("<title>T | Vedic Portal</title>") == "T"
    assert files.html_title("<h1>Head</h1>") == "Head"
    page = '<header>x</header><div id="videotext"><p>अग्नि॑</p><br><p>latin</p></div><div class="modal">अग्नि</div>'
    assert files.scripture(page) == "अग्नि॑"
    assert files.scripture(None) is None


def test_sheet(spark, tmp_path):
    _sheet(tmp_path / "z.xlsx")
    rows = files.sheet_table(files.scan(spark, str(tmp_path)))
    assert sorted((r.place, r.part, r.text) for r in rows.collect()) == [("b01_h001_01", "a", "agnim"), ("b01_h001_01", "b", "ile")]
    v = files.sheet_verses(rows).first()
    assert (v.book, v.hymn, v.verses[0].n, v.verses[0].text) == (1, 1, 1, "agnim\nile")


def test_scripture_json(spark):
    payloads = ['[{"mandala": 1, "sukta": 1, "text": "x"}]', '{"work": "yajurveda"}', '{"veda": "Samaveda", "verses": []}', '[{"chapter": 1, "verse": 2}]', '[{"kanda": 1}]', "{bad", None]
    df = spark.createDataFrame([(p,) for p in payloads], "p string")
    assert [r[0] for r in df.select(scripture.shape(F.col("p"))).collect()] == ["rigveda", "yajurveda", "samaveda", "bhagavad-gita", "atharvaveda", None, None]
    h = spark.createDataFrame([("१", 2, "ऋषिः । देवता\nअ ॥१॥\nआ ॥२॥"), ("1", 3, "no marks"), (None, 1, "अ ॥१॥")], "book string, hymn int, text string")
    got = scripture.compact_hymns(h, "book", "hymn").collect()
    assert [(r.book, r.hymn, r.heading, [(v.n, v.text) for v in r.verses]) for r in got] == [(1, 2, "ऋषिः । देवता", [(1, "अ"), (2, "आ")])]
    text = scripture.compact_hymns(h, "book", "hymn").select(scripture.render(F.format_string("HYMN %d.%d", "book", "hymn"), F.col("heading"), F.col("verses"))).first()[0]
    from lipika.operators.units import hymns

    assert [(u["book"], u["hymn"], u["verse"], u["text"]) for u in hymns(text, "rigveda", None, None)] == [(1, 2, 1, "अ"), (1, 2, 2, "आ")]
    s = spark.createDataFrame([("Part Second", "Book IV", "2", 1, "Indra", None, 2, "b"), ("Part Second", "Book IV", "2", 1, "Indra", None, 1, "a"), (None, None, None, None, None, "sec", 1, "c"), ("1", "1", "1", 1, None, None, None, "x")], "part string, book string, chapter string, hymn int, deity string, section string, verse int, text string")
    got = scripture.compact_four_part(s).orderBy("part").collect()
    assert [(r.part, r.book, r.chapter, r.hymn, r.heading, [v.text for v in r.verses]) for r in got] == [(1, 1, 1, 1, "sec", ["c"]), (2, 4, 2, 1, "Indra", ["a", "b"])]
    c = spark.createDataFrame([(2, 2, " b "), (2, 1, "a"), (2, 3, ""), (None, 1, "x")], "chapter int, verse int, text string")
    assert [(r.chapter, [(v.n, v.text) for v in r.verses]) for r in scripture.compact_chapters(c).collect()] == [(2, [(1, "a"), (2, "b")])]


def test_generated(spark):
    assert corpus.hymn_manifest(spark).count() == 1028
    assert corpus.hymn_manifest(spark, "1,9-10").count() == 191 + 114 + 191
    maps = spark.createDataFrame([("<loc> https://A.org/2 </loc><loc>https://a.org/1</loc><loc>https://b.org/1</loc>",)], "value string")
    assert [r.url for r in corpus.sitemap_urls(maps, "a.org").collect()] == ["https://A.org/2", "https://a.org/1"]


def _payloads(spark, *payloads):
    import json

    rows = [(i, None, None, None, p if isinstance(p, str) else json.dumps(p, ensure_ascii=False)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "ord long, tradition string, license string, attribution string, payload string")


def test_payloads_expand(spark):
    from lipika.sources import scripture

    gita = {"BhagavadGitaChapter": [{"chapter": 2, "verse": 3, "text": "c "}, {"chapter": 2, "verse": 1, "text": "a"}, {"chapter": 2, "verse": 2, "text": " "}]}
    hymns = [{"veda": "rigveda", "mandala": 10, "sukta": 129, "text": "७ ऋषिः। छन्दः।\nपूर्वम् ॥१॥\nपरम् ॥२॥"}, {"mandala": 10, "sukta": 90, "text": "none"}]
    four = {"veda": "Samaveda", "verses": [{"part": "SECOND PART", "book": "Book IV", "chapter": "Chapter I", "hymn": 1, "deity": "Agni", "verse": v, "text": f"v{v}"} for v in (2, 1)]}
    chapters = {"work": "yajurveda", "samhita": "vs", "license": "CC0", "adhyayas": [{"adhyaya": 1, "verses": [{"n": 1, "text": "x"}]}, {"adhyaya": 2, "verses": []}]}
    kaanda = {"work": "atharvaveda", "kaanda": 1, "suktas": [{"sukta": n, "heading": "h", "verses": [{"n": 1, "text": "y"}]} for n in (2, 1)]}
    got = scripture.expand(_payloads(spark, gita, hymns, four, chapters, kaanda, "no json", "{}", None)).orderBy("ord", "pos").collect()
    assert [(r.ord, r.pos, r.title) for r in got] == [
        (0, 1, "Bhagavad-gītā 2 (Sanskrit, DharmicData)"), (1, 1, "Rigveda RV 10.129 (Sanskrit, DharmicData)"), (2, 1, "Sāmaveda SV 2.4.1.1 (Griffith, DharmicData)"), (3, 1, "Yajurveda VS 1 (Sanskrit, DharmicData)"),
        (4, 1, "Atharvaveda AV 1.1 (Sanskrit, DharmicData)"), (4, 2, "Atharvaveda AV 1.2 (Sanskrit, DharmicData)"),
    ]
    text = [r.text for r in got]
    assert text[0] == "CHAPTER 2 — Sanskrit (DharmicData)\n\n2.1 a\n\n2.3 c\n"
    assert text[1] == "HYMN 10.129 — ऋषिः। छन्दः\n\n1. पूर्वम्\n\n2. परम्\n"
    assert text[2] == "HYMN 2.4.1.1 — Agni\n\n1. v1\n\n2. v2\n" and got[2].language == "en"
    assert text[3] == "ADHYAYA 1 — vs\n\n1. x\n" and got[3].license == "cc0" and got[0].license == "odbl"
    assert text[4] == "HYMN 1.1 — h\n\n1. y\n" and got[4].source_url.endswith("atharvaveda_kaanda_1.json#sukta-1")
    assert scripture.expand(_payloads(spark, "[]")).count() == 0


def test_manifest_run(spark):
    """Each way a source can go, in one run."""
    from lipika.operators import ingest

    body = "a text that is long enough to be kept, " * 4
    page = "<html><title>Isha</title><div id='videotext'>ईशा वास्यम्<br>द्वितीयम्</div></html>"
    rows = [
        ("one", "https://a.org/1", "public-domain", None, None), ("copy", "https://a.org/2", "public-domain", None, None), ("short", "https://a.org/3", "cc0", None, None), ("gone", "https://a.org/4", "cc0", None, None),
        ("closed", "https://a.org/5", "all rights", None, None), ("listed", "https://a.org/6", "cc0", False, None), ("portal", "https://v.org/isha", "gov-ind", True, "vedicheritage"), ("empty", "https://v.org/x", "gov-ind", True, "vedicheritage"),
        ("json", "https://a.org/7.json", "odbl", True, None), ("known", "https://a.org/8", "cc0", None, None),
    ]
    sources = spark.createDataFrame([(i, t, u, "Vedic", "EN", lic, d, k, None) for i, (t, u, lic, d, k) in enumerate(rows)], "ord long, title string, url string, tradition string, language string, license string, download boolean, source_class string, attribution string")
    texts = {"https://a.org/1": body, "https://a.org/2": body.upper(), "https://a.org/3": "short", "https://a.org/5": body, "https://v.org/isha": page, "https://v.org/x": "<p>none</p>", "https://a.org/7.json": '{"work":"atharvaveda","kaanda":1,"suktas":[{"sukta":1,"verses":[{"n":1,"text":"y"}]}]}', "https://a.org/8": body + "other"}
    fetched = spark.createDataFrame([(u, t, None) for u, t in texts.items()] + [("https://a.org/4", None, "timeout")], "url string, text string, error string")
    known = spark.createDataFrame([("f", "https://a.org/8")], "fingerprint string, source_url string")
    new, counters, errors = ingest.ingest(sources, fetched, known)
    assert {r.counter: r.value for r in counters.collect()} == {"total_sources": 10, "accepted": 8, "skipped_license": 1, "skipped_download_flag": 1, "failed": 1, "empty_or_short": 2, "duplicates": 2, "added": 3}
    assert sorted(r.title for r in new.collect()) == ["Atharvaveda AV 1.1 (Sanskrit, DharmicData)", "one", "portal"]
    portal = new.where("language = 'sa' and license = 'gov-ind'").first()
    assert portal.text == "ईशा वास्यम्\nद्वितीयम्" and portal.char_count == len(portal.text)
    assert [tuple(r) for r in errors.collect()] == [("https://a.org/4", "timeout")]
    assert {r.value for r in ingest.ingest(sources.where("false"), fetched)[1].collect()} == {0}
