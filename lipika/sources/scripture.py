"""Structured scripture JSON: payload shapes, compact forms, canonical texts, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lipika.functions import fixed, text as T

VERSES = "array<struct<n:int,text:string>>"


def shape(payload: Column) -> Column:
    """Which of the known payloads a JSON text is, else null. Broken JSON is null."""
    v = F.try_parse_json(payload)
    get = lambda p: F.try_variant_get(v, p, "string")
    work = get("$.work")
    return (
        F.when(v.isNull(), None)
        .when((work == "bhagavad-gita") | get("$.BhagavadGitaChapter[0]").isNotNull() | (get("$[0].chapter").isNotNull() & get("$[0].verse").isNotNull()), "bhagavad-gita")
        .when((work == "rigveda") | get("$[0].mandala").isNotNull(), "rigveda")
        .when((work == "yajurveda") | get("$[0].adhyaya").isNotNull(), "yajurveda")
        .when((work == "atharvaveda") | get("$[0].kaanda").isNotNull() | get("$[0].kanda").isNotNull(), "atharvaveda")
        .when((work == "samaveda") | (F.lower(get("$.veda")) == "samaveda") | get("$.verses[0].part").isNotNull(), "samaveda")
    )


def marked_verses(text: Column) -> Column:
    """struct(heading, verses) of a text whose verses end in `॥n॥`; a first line with a single danda is the heading."""
    body = T.strip(text)
    first = F.split_part(body, F.lit("\n"), F.lit(1))
    headed = F.contains(first, F.lit("।")) & ~F.contains(first, F.lit("॥")) & ~F.contains(first, F.lit("।।"))
    heading = F.when(headed, F.nullif(F.regexp_replace(F.regexp_replace(T.strip(first), r"^[0-9०-९]+\s*", ""), "^[ ।]+|[ ।]+$", ""), F.lit("")))
    body = F.when(headed, F.regexp_replace(body, r"^[^\n]*\n?", "")).otherwise(body)
    mark = r"(?:॥|।।)\s*([0-9०-९]+)\s*(?:॥|।।)"
    parts, numbers = F.split(body, r"(?:॥|।।)\s*[0-9०-९]+\s*(?:॥|।।)", -1), F.regexp_extract_all(body, F.lit(mark), F.lit(1))
    verses = F.transform(F.arrays_zip(F.slice(parts, 1, F.size(numbers)).alias("t"), numbers.alias("d")), lambda x: F.struct(T.devanagari_int(x["d"]).alias("n"), T.strip(x["t"]).alias("text")))
    return F.struct(heading.alias("heading"), F.filter(verses, lambda x: x["n"].isNotNull() & (x["text"] != "")).alias("verses"))


def _clean(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.where(T.strip(F.coalesce(F.col(text), F.lit(""))) != "")


def compact_chapters(rows: DataFrame) -> DataFrame:
    """(chapter, verses) of rows (chapter, verse, text): verses in order; rows without number or text go."""
    rows = _clean(rows).where("chapter is not null and verse is not null")
    return rows.groupBy(F.col("chapter").cast("int").alias("chapter")).agg(F.array_sort(F.collect_list(F.struct(F.col("verse").cast("int").alias("n"), T.strip(F.col("text")).alias("text")))).alias("verses"))


def compact_hymns(rows: DataFrame, book: str, hymn: str) -> DataFrame:
    """(book, hymn, heading, verses) of rows (book, hymn, text) with marked verses; hymns without verses go.

    Numbers may be in Devanagari digits."""
    number = lambda c: F.translate(F.col(c).cast("string"), "०१२३४५६७८९", "0123456789").try_cast("int")
    rows = rows.select(number(book).alias("book"), (number(hymn) if hymn else F.lit(None).cast("int")).alias("hymn"), marked_verses(F.col("text")).alias("m"))
    return rows.where(F.col("book").isNotNull() & (F.size("m.verses") > 0)).select("book", "hymn", "m.heading", "m.verses")


def compact_four_part(rows: DataFrame) -> DataFrame:
    """(part, book, chapter, hymn, heading, verses) of rows with those columns as numbers or as `Book IV`."""
    token = lambda c: F.coalesce(T.int_or_roman(F.coalesce(F.nullif(F.regexp_extract(F.col(c).cast("string"), r"(?i)\b([IVXLCDM]+|\d+)\s*$", 1), F.lit("")), F.col(c).cast("string"))), F.lit(1))
    raw = F.upper(F.coalesce(F.col("part").cast("string"), F.lit("1")))
    part = F.when(raw.contains("SECOND") | F.trim(raw).isin("2", "II"), 2).otherwise(1)
    rows = _clean(rows).where("verse is not null")
    heading = F.nullif(T.strip(F.coalesce(F.nullif("deity", F.lit("")), F.col("section"), F.lit(""))), F.lit(""))
    rows = rows.select(part.alias("part"), token("book").alias("book"), token("chapter").alias("chapter"), F.coalesce(F.col("hymn").cast("int"), F.lit(1)).alias("hymn"), heading.alias("heading"), F.struct(F.col("verse").cast("int").alias("n"), T.strip(F.col("text")).alias("text")).alias("v"))
    return rows.groupBy("part", "book", "chapter", "hymn").agg(F.first("heading", ignorenulls=True).alias("heading"), F.array_sort(F.collect_list("v")).alias("verses"))


def render(title: Column, heading: Column, verses: Column, numbering: Column | None = None) -> Column:
    """Canonical text: title line with heading, then `n. text` (or `c.n text`) blocks; what the unit parsers read back."""
    head = F.when(F.coalesce(heading, F.lit("")) != "", F.concat(title, F.lit(" — "), heading)).otherwise(title)
    lead = (lambda v: F.concat(numbering.cast("string"), F.lit("."), v["n"].cast("string"), F.lit(" "))) if numbering is not None else (lambda v: F.concat(v["n"].cast("string"), F.lit(". ")))
    return F.concat(F.array_join(F.concat(F.array(head), F.transform(verses, lambda v: F.concat(lead(v), v["text"]))), "\n\n"), F.lit("\n"))


def hymn_url(base: Column, book: Column, hymn: Column) -> Column:
    """Address of a hymn within an edition."""
    return F.concat(base, F.format_string("#%02d.%03d", book, hymn))


_ITEM = "struct<chapter:string,verse:string,n:string,text:string,mandala:string,kaanda:string,kanda:string,sukta:string,adhyaya:string,samhita:string,heading:string,part:string,book:string,section:string,hymn:string,deity:string,veda:string,verses:array<struct<n:string,verse:string,text:string>>>"
_WHOLE = f"struct<work:string,veda:string,chapter:string,mandala:string,kaanda:string,samhita:string,edition:string,source_url:string,language:string,license:string,attribution:string,BhagavadGitaChapter:array<{_ITEM}>,verses:array<{_ITEM}>,suktas:array<{_ITEM}>,adhyayas:array<{_ITEM}>,hymns:array<{_ITEM}>>"


def _int(c: Column) -> Column:
    return F.translate(c, "०१२३४५६७८९", "0123456789").try_cast("int")


def expand(payloads: DataFrame) -> DataFrame:
    """Records of structured payloads, one per hymn or chapter: the source's columns (ord, tradition, license, attribution)
    and `payload` become (ord, pos, id, text, source_url, title, tradition, language, license, fingerprint, char_count,
    attribution).

    A licence or attribution the payload states goes before the source's; without any the licence is odbl. Payloads of no
    known shape, broken JSON and items without numbers or verses give nothing. `ord` must be unique."""
    whole, items = F.from_json("payload", _WHOLE), F.from_json("payload", f"array<{_ITEM}>")
    rows = payloads.select("ord", "tradition", "license", "attribution", shape(F.col("payload")).alias("shape"), whole.alias("p"), items.alias("bare")).where("shape is not null")
    none = F.array().cast(f"array<{_ITEM}>")
    compact = F.col("p.work").isNotNull()
    listed = F.coalesce(
        F.when(F.col("shape") == "bhagavad-gita", F.coalesce("p.BhagavadGitaChapter", "p.verses")).when(F.col("shape") == "samaveda", F.coalesce("p.hymns", "p.verses")).when(F.col("shape") == "yajurveda", F.col("p.adhyayas")).otherwise(F.col("p.suktas")), "bare", none
    )
    # what a payload says about itself; raw ones are of the one known collection
    said = lambda c, raw: F.when(compact, F.nullif(f"p.{c}", F.lit(""))).otherwise(F.lit(raw))
    rows = rows.select(
        "ord", "tradition", "shape", compact.alias("compact"), listed.alias("items"), "p.chapter", F.coalesce("p.mandala", "p.kaanda").alias("volume"), "p.samhita", "p.edition", "p.source_url", "p.language",
        F.lower(F.coalesce(said("license", "odbl"), F.nullif("license", F.lit("")), F.lit("odbl"))).alias("license"),
        F.coalesce(said("attribution", fixed.COLLECTION_ATTRIBUTION), F.nullif("attribution", F.lit("")), F.lit(fixed.COLLECTION_ATTRIBUTION)).alias("attribution"),
    )
    base = [c for c in rows.columns if c != "items"]
    item = rows.select(*base, F.posexplode("items").alias("place", "i"))
    pair = lambda v: F.struct(_int(F.coalesce(v["n"], v["verse"])).alias("n"), v["text"].alias("text"))

    # a chapter is the whole payload, a four-part hymn a group of its verses; both gather single verses
    chapter = F.coalesce(F.when(F.col("compact"), _int(F.col("chapter"))), _int(F.col("i.chapter")))
    single = item.where("shape = 'bhagavad-gita' or (shape = 'samaveda' and not compact)").where(T.strip(F.coalesce("i.text", F.lit(""))) != "")
    number = F.coalesce(_int(F.col("i.verse")), _int(F.col("i.n")))
    token = lambda c: F.coalesce(T.int_or_roman(F.coalesce(F.nullif(F.regexp_extract(F.col(c), r"(?i)(?:book|part|chapter|decade)\s+([IVXLCDM]+|\d+)", 1), F.lit("")), F.col(c))), F.lit(1))
    raw_part = F.upper(F.coalesce("i.part", F.lit("1")))
    four = F.array(F.when(raw_part.contains("SECOND") | F.trim(raw_part).isin("2", "II"), 2).otherwise(1), token("i.book"), token("i.chapter"), F.coalesce(_int(F.col("i.hymn")), F.lit(1)))
    numbers = F.when(F.col("shape") == "bhagavad-gita", F.array(chapter)).otherwise(four)
    heading = F.when(F.col("shape") == "samaveda", F.nullif(T.strip(F.coalesce(F.nullif("i.deity", F.lit("")), F.col("i.section"), F.lit(""))), F.lit("")))
    single = single.select(*base, numbers.alias("numbers"), heading.alias("heading"), F.struct(number.alias("n"), F.col("place"), T.strip(F.col("i.text")).alias("text")).alias("v")).where("v.n is not null and numbers[0] is not null")
    keys = [c for c in base if c not in ("chapter",)]
    # a payload is one file, so the verses of a chapter or hymn are few
    gathered = single.groupBy(*keys, "numbers").agg(F.min_by("heading", "v.place").alias("heading"), F.transform(F.array_sort(F.collect_list("v")), lambda v: F.struct(v["n"].alias("n"), v["text"].alias("text"))).alias("verses"))

    # elsewhere an item is a hymn, with verses of its own or marked in its text
    book = F.coalesce(F.when(F.col("compact"), _int(F.col("volume"))), _int(F.coalesce("i.mandala", "i.kaanda", "i.kanda")), _int(F.col("volume")))
    hymn = F.coalesce(_int(F.col("i.sukta")), _int(F.col("i.hymn")))
    own = F.size(F.coalesce("i.verses", F.array().cast("array<struct<n:string,verse:string,text:string>>"))) > 0
    marked = marked_verses(F.col("i.text"))
    verses = F.when(own, F.filter(F.transform("i.verses", pair), lambda v: v["n"].isNotNull() & (F.coalesce(v["text"], F.lit("")) != ""))).otherwise(marked["verses"])
    numbers = F.when(F.col("shape") == "yajurveda", F.array(_int(F.col("i.adhyaya")))).when(F.col("shape") == "samaveda", F.array(*(_int(F.col(f"i.{c}")) for c in ("part", "book", "chapter", "hymn")))).otherwise(F.array(book, hymn))
    hymns = item.where("shape in ('rigveda', 'atharvaveda', 'yajurveda') or (shape = 'samaveda' and compact)")
    hymns = hymns.select(*keys, numbers.alias("numbers"), F.when(own, F.nullif("i.heading", F.lit(""))).otherwise(marked["heading"]).alias("heading"), verses.alias("verses"))
    both = gathered.unionByName(hymns.where(F.forall("numbers", lambda x: x.isNotNull()) & (F.size("verses") > 0)))
    return _records(both)


def _records(rows: DataFrame) -> DataFrame:
    n = lambda i: F.get("numbers", F.lit(i)).cast("string")
    dotted = F.array_join(F.transform("numbers", lambda x: x.cast("string")), ".")
    shape_ = F.col("shape")
    edition = F.concat(F.lit(" ("), F.coalesce(F.when(shape_.isin("rigveda", "samaveda"), F.nullif("edition", F.lit(""))), F.when(shape_ == "samaveda", fixed.COLLECTION_GRIFFITH).otherwise(fixed.COLLECTION_SANSKRIT)), F.lit(")"))
    title = F.concat(F.element_at(F.create_map(*(F.lit(x) for kv in fixed.PAYLOAD_TITLES.items() for x in kv)), shape_), dotted, edition)
    sheet = F.contains(F.lower(F.coalesce("source_url", F.lit(""))), F.lit("vedaweb")) | F.contains(F.coalesce("edition", F.lit("")), F.lit("VedaWeb"))
    page = lambda *parts: F.concat(F.lit(f"{fixed.COLLECTION_URL}/blob/main/"), *(F.lit(p) if isinstance(p, str) else p for p in parts))
    url = (
        F.when(shape_ == "bhagavad-gita", page("SrimadBhagvadGita/bhagavad_gita_chapter_", n(0), ".json"))
        .when((shape_ == "rigveda") & sheet, F.concat(F.lit(fixed.SHEET_URL), F.format_string("#%02d.%03d", F.get("numbers", F.lit(0)), F.get("numbers", F.lit(1)))))
        .when(shape_ == "rigveda", page("Rigveda/rigveda_mandala_", n(0), ".json#sukta-", n(1)))
        .when(shape_ == "yajurveda", page("Yajurveda/vajasneyi_madhyadina_samhita.json#adhyaya-", n(0)))
        .when(shape_ == "atharvaveda", page("AtharvaVeda/atharvaveda_kaanda_", n(0), ".json#sukta-", n(1)))
        .otherwise(page("Samaveda/Samaveda.json#p", n(0), "-b", n(1), "-c", n(2), "-h", n(3)))
    )
    head = F.when(shape_ == "bhagavad-gita", F.concat(F.lit("CHAPTER "), n(0))).when(shape_ == "yajurveda", F.concat(F.lit("ADHYAYA "), n(0))).otherwise(F.concat(F.lit("HYMN "), dotted))
    heading = F.when(shape_ == "bhagavad-gita", F.lit(fixed.COLLECTION_HEADING)).when(shape_ == "yajurveda", F.coalesce(F.nullif("heading", F.lit("")), "samhita", F.when(~F.col("compact"), F.lit(fixed.SAMHITA)))).otherwise(F.col("heading"))
    text = F.when(shape_ == "bhagavad-gita", render(head, heading, F.col("verses"), n(0))).otherwise(render(head, heading, F.col("verses")))
    language = F.when(shape_ == "samaveda", "en").when((shape_ == "rigveda") & F.col("compact"), F.coalesce(F.nullif("language", F.lit("")), F.lit("sa"))).otherwise("sa")
    tradition = F.coalesce(F.nullif("tradition", F.lit("")), F.when(shape_ == "bhagavad-gita", "vaishnava").otherwise("vedic"))
    made = rows.select("ord", "numbers", text.alias("text"), url.alias("source_url"), title.alias("title"), F.lower(tradition).alias("tradition"), F.lower(language).alias("language"), "license", "attribution")
    made = made.withColumn("fingerprint", T.content_fingerprint(F.col("text")))
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("ord").orderBy("numbers", "source_url"))  # the hymns of one file
    return made.select("ord", pos.alias("pos"), T.stable_id(F.col("source_url"), F.col("title"), F.substring("fingerprint", 1, 16)).alias("id"), "text", "source_url", "title", "tradition", "language", "license", "fingerprint", F.length("text").alias("char_count"), "attribution")
