"""Files into text: binary scan, decoding, markup, archives, sheets. Parsing runs per file in Arrow batches."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lipika.functions import text as T
from lipika.settings import bounded

DROPPED = frozenset({"script", "style", "noscript", "nav", "footer", "header"})
BLOCKS = frozenset({"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "blockquote", "title"})
#: Largest file that is read, in bytes; set by LIPIKA_MAX_BYTES, a megabyte at least.
MAX_BYTES = bounded("LIPIKA_MAX_BYTES", 26_214_400, 1_048_576)


def scan(spark: SparkSession, path: str, most: int = MAX_BYTES) -> DataFrame:
    """(path, length, content) of the files under a folder; the content of a file over `most` bytes is null and not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    large = files.where(F.col("length") > most).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return files.where(F.col("length") <= most).select("path", "length", "content").unionByName(large)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files under a folder; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def decode(data: bytes | None) -> str | None:
    """Text of bytes: UTF-8, with mark, UTF-16 with mark or with every second byte zero, else Latin-1."""
    if data is None:
        return None
    zeros = [data[i::2].count(0) * 4 > len(data) for i in (0, 1)] if len(data) > 3 else [False, False]
    encodings = ["utf-16"] if data[:2] in (b"\xff\xfe", b"\xfe\xff") else ["utf-16-le"] if zeros[1] and not zeros[0] else ["utf-16-be"] if zeros[0] and not zeros[1] else []
    for encoding in (*encodings, "utf-8-sig"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


class _Text(HTMLParser):
    """Text of a page without the dropped elements; with `only`, of the element of that id alone."""

    def __init__(self, only: str | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.dropped = 0
        self.only, self.depth = only, 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in DROPPED:
            self.dropped += 1
        if self.only and tag not in ("br", "img", "hr", "meta", "link", "input") and (self.depth or dict(attrs).get("id") == self.only):
            self.depth += 1
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED:
            self.dropped = max(0, self.dropped - 1)
        if self.only and self.depth:
            self.depth -= 1
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.dropped and (not self.only or self.depth):
            self.parts.append(data)


def html_text(page: str | None, only: str | None = None) -> str | None:
    """Text of a page, one line per text block, without scripts, styles and page furniture."""
    if page is None:
        return None
    parser = _Text(only)
    parser.feed(page)
    parser.close()
    return "\n".join(x for line in "".join(parser.parts).split("\n") if (x := " ".join(line.split())))


def html_title(page: str | None) -> str | None:
    """Title of a page without the site's suffix, else its first heading."""
    for pattern in (r"(?is)<title[^>]*>(.*?)</title>", r"(?is)<h1[^>]*>(.*?)</h1>", r"(?is)<h2[^>]*>(.*?)</h2>"):
        if m := re.search(pattern, page or ""):
            if t := re.sub(r"\s*\|\s*[^|]*Portal\s*$", "", html_text(m[1]) or "").strip():
                return t
    return None


def scripture(page: str | None) -> str | None:
    """Lines with Devanagari of the page's scripture block: the known block, else the whole page."""
    for only in ("videotext", "content", None):
        lines = [x for x in (html_text(page, only) or "").split("\n") if any("ऀ" <= c <= "ॿ" for c in x)]
        if lines:
            return "\n".join(lines)
    return None


def epub_text(data: bytes) -> str:
    """Text of the pages of an e-book archive in name order, parted by blank lines."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        pages = [n for n in sorted(z.namelist()) if n.lower().endswith((".xhtml", ".html", ".htm"))]
        return "\n\n".join(t for n in pages if (t := html_text(decode(z.read(n)))))


def pdf_text(data: bytes) -> str:
    """Text of the pages of a PDF; needs pypdf, unreadable pages are skipped."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs the optional package pypdf") from e
    pages = []
    for page in PdfReader(io.BytesIO(data)).pages:
        try:
            pages.append(page.extract_text() or "")
        except Exception:  # noqa: BLE001 - a broken page loses itself only
            continue
    return "\n\n".join(p for p in pages if p.strip())


EXTRACTORS: dict[str, Callable[[bytes], str | None]] = {
    ".txt": decode,
    ".xml": lambda b: html_text(decode(b)),
    ".html": lambda b: html_text(decode(b)),
    ".htm": lambda b: html_text(decode(b)),
    ".epub": epub_text,
    ".pdf": pdf_text,
    ".json": decode,
}


def extract(files: DataFrame) -> DataFrame:
    """(path, text, error) of scanned files by their extension; a file that can't be read has an error and no text."""
    kind = StructType([StructField("text", StringType()), StructField("error", StringType())])

    @F.pandas_udf(kind)
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ext, content in batches:
            rows = []
            for e, data in zip(ext, content, strict=True):
                try:
                    if data is None:
                        rows.append((None, "file too large"))
                        continue
                    rows.append((EXTRACTORS[e](data), None) if e in EXTRACTORS else (None, f"no reader for {e}"))
                except Exception as problem:  # noqa: BLE001 - one bad file must not end the job
                    rows.append((None, str(problem)[:160]))
            yield pd.DataFrame(rows, columns=["text", "error"])

    rows = files.select("path", read(T.url_extension(F.col("path")), F.col("content")).alias("r"))
    return rows.select("path", T.normalize_whitespace(F.col("r.text")).alias("text"), "r.error")


def html_col(page: Column) -> Column:
    """Column form of `html_text`."""

    @F.pandas_udf(StringType())
    def column(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in pages:
            yield pd.Series([html_text(p) for p in s], dtype=object)

    return column(page)


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def sheet_rows(data: bytes) -> list[tuple[str, str, str]]:
    """Columns A, B, C of a workbook's first sheet, without its header and rows without text."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        sheet = ElementTree.fromstring(z.read(next(n for n in sorted(z.namelist()) if n.startswith("xl/worksheets/sheet"))))
    out = []
    for row in sheet.iter(f"{{{_NS['m']}}}row"):
        cells = {}
        for c in row.findall("m:c", _NS):
            value = c.find("m:v", _NS)
            inline = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
            text = shared[int(value.text)] if c.get("t") == "s" and value is not None else value.text if value is not None else inline
            cells[re.sub(r"\d", "", c.get("r", ""))] = (text or "").strip()
        a, b, t = (cells.get(k, "") for k in "ABC")
        if t and not a.lower().startswith("belege"):
            out.append((a, b, t))
    return out


def sheet_table(files: DataFrame) -> DataFrame:
    """(path, row_no, place, part, text) of scanned workbooks; of one place and part the first row counts."""
    kind = ArrayType(StructType([StructField(n, StringType()) for n in ("place", "part", "text")]))

    @F.pandas_udf(kind)
    def read(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in contents:
            yield pd.Series([[{"place": a, "part": b, "text": t} for a, b, t in sheet_rows(d)] for d in s], dtype=object)

    from lipika.operators.dedupe import first_per_key

    rows = files.select("path", F.posexplode(read("content")).alias("row_no", "r")).select("path", "row_no", "r.*")
    return first_per_key(rows, ["path", "place", "part"], [F.col("row_no")])


def place_reference(place: Column) -> Column:
    """struct(book, hymn, verse) of a place like b01_h001_01, else null."""
    n = F.transform(F.regexp_extract_all(place, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    return F.when(F.size(n) >= 3, F.struct(n[0].alias("book"), n[1].alias("hymn"), n[2].alias("verse")))


def sheet_verses(table: DataFrame) -> DataFrame:
    """(book, hymn, verses): parts joined in letter order to verses, verses in order."""
    rows = table.withColumn("ref", place_reference(F.col("place"))).where("ref is not null")
    verse = rows.groupBy("ref.book", "ref.hymn", "ref.verse").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return verse.groupBy("book", "hymn").agg(F.array_sort(F.collect_list(F.struct(F.col("verse").alias("n"), "text"))).alias("verses"))
