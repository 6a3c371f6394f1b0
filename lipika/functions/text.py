"""String and hash expressions. All are Column expressions, so they stay in generated code.

Nulls follow the data model: null, missing and '' are alike wherever a default is documented."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space as Unicode has it; Java's own \\s is ASCII only.
SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(c: Column) -> Column:
    """Without white space at both ends; null stays null."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def or_default(c: Column, default: str) -> Column:
    """`default` for null and ''."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def normalize_whitespace(c: Column) -> Column:
    """CRLF to LF, runs of space and tab to one space, three or more line ends to two, stripped."""
    unix = F.regexp_replace(c, "\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(unix, "[ \t]+", " "), "\n{3,}", "\n\n"))


def stable_id(*parts: Column) -> Column:
    """24 hex digits of the parts joined by `|`; a null part counts as ''."""
    blob = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.substring(F.sha2(blob, 256), 1, 24)


def content_fingerprint(text: Column) -> Column:
    """sha256 of the lower-cased, white-space-collapsed text."""
    return F.sha2(strip(F.regexp_replace(F.lower(text), f"{SPACE}+", " ")), 256)


def preview(text: Column, size: int = 280) -> Column:
    """White space collapsed, cut to size-1 code points and an ellipsis if longer than `size`; '' for null."""
    flat = strip(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " "))
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size - 1), F.lit("…"))).otherwise(flat)


def has_devanagari(text: Column) -> Column:
    """Any code point of the Devanagari block; false for null."""
    return F.coalesce(text.rlike(r"[\x{900}-\x{97F}]"), F.lit(False))


def devanagari_length(text: Column) -> Column:
    """Number of Devanagari code points; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\x{900}-\x{97F}]")), F.lit(0))


def devanagari_int(token: Column) -> Column:
    """Positive integer written in Devanagari or ASCII digits, else null."""
    n = strip(F.translate(token, "०१२३४५६७८९", "0123456789")).try_cast("int")
    return F.when(n > 0, n)


def int_or_roman(token: Column) -> Column:
    """Positive integer in decimal or Roman numerals, else null."""
    raw = F.replace(F.upper(strip(token)), F.lit(" "), F.lit(""))
    letters = F.transform(F.split(F.reverse(raw), ""), lambda x: F.element_at(F.create_map(*(F.lit(v) for kv in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for v in kv)), x))
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("top"))
    roman = F.aggregate(
        letters,
        zero,
        lambda a, v: F.when(v < a["top"], F.struct((a["total"] - v).alias("total"), a["top"].alias("top"))).otherwise(F.struct((a["total"] + v).alias("total"), v.alias("top"))),
        lambda a: a["total"],
    )
    n = F.when(raw.rlike("^[0-9]+$"), raw.try_cast("int")).when(raw.rlike("^[IVXLCDM]+$"), roman)
    return F.when(n > 0, n)


def lines(text: Column) -> Column:
    """Array of lines, all line ends alike."""
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)


def url_extension(url: Column, content_type: Column | None = None) -> Column:
    """File extension by address, else by content type, else `.bin`."""
    found = F.regexp_extract(F.lower(F.regexp_replace(url, "[?#].*$", "")), r"\.(pdf|epub|html?|txt|json|xml|xlsx)$", 0)
    by_type = F.lit(".bin")
    if content_type is not None:
        t = F.lower(content_type)
        by_type = F.when(t.contains("pdf"), ".pdf").when(t.contains("epub"), ".epub").when(t.contains("html"), ".html").when(t.contains("json"), ".json").when(t.contains("xml"), ".xml").when(t.contains("text"), ".txt").otherwise(".bin")
    return F.when(F.coalesce(found, F.lit("")) != "", found).otherwise(by_type)


def canonical_url(url: Column) -> Column:
    """The static mirror's address for pages of the site whose live pages need scripts."""
    return F.regexp_replace(url, r"^https?://(?:www\.)?sacred-texts\.com/", "https://archive.sacred-texts.com/")


def url_is_public(url: Column) -> Column:
    """Scheme http(s), a host, and no loopback name or private literal address (what can be said without DNS)."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    private = r"^(localhost|.*\.local|.*\.internal|127\..*|10\..*|192\.168\..*|169\.254\..*|0\..*|172\.(1[6-9]|2[0-9]|3[01])\..*|\[.*\])$"
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & (host != "") & ~host.rlike(private), F.lit(False))


def safe_name(c: Column, size: int = 80) -> Column:
    """File name from any string."""
    return F.substring(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_"), 1, size)


def strip_ebook_markers(text: Column) -> Column:
    """What lies between the START and END marker lines of a public e-book; all of it where they are missing."""
    body = F.regexp_replace(text, r"(?is)^.*?\*\*\*\s*START OF (?:THE|THIS) PROJECT [^\n]*\n", "")
    return strip(F.regexp_replace(body, r"(?is)\n?\*\*\*\s*END OF (?:THE|THIS) PROJECT .*$", ""))


def strip_locator_tags(text: Column) -> Column:
    """Without `[RV 1.1.1] ` at the start of lines."""
    return F.regexp_replace(text, r"(?m)^\[(?:RV|BG|YS)[^\]]+\]\s*", "")


def citation_label(locator: Column, title: Column, missing: str = "fonte") -> Column:
    """`locator — title`, or what there is of it."""
    a, b = (F.nullif(strip(F.coalesce(x, F.lit(""))), F.lit("")) for x in (locator, title))
    return F.coalesce(F.when(a.isNotNull() & b.isNotNull(), F.concat(a, F.lit(" — "), b)), a, b, F.lit(missing))


def metadata_blob(*parts: Column) -> Column:
    """The parts joined by single spaces, '' for null, so that empty slots stay."""
    return F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts))


def meta_line(*parts: Column) -> Column:
    """The parts that are neither null nor '' joined by single spaces."""
    return F.trim(F.array_join(F.array_compact(F.array(*(F.nullif(x, F.lit("")) for x in parts))), " "))


def vector_literal(v: Column) -> Column:
    """`[x.xxxxxxxx,...]` with eight decimals, exact halves to the even digit; null for null.

    Exact halves end in 5 in the ninth place and hold nothing beyond it; `format_string` takes those up."""

    def literal(x: Column) -> Column:
        d = x.cast("double")
        text = F.format_string("%.8f", d)
        scaled = F.abs(d) * F.lit(1e9)
        half = (scaled == F.floor(scaled)) & (F.pmod(F.floor(scaled), F.lit(10)) == 5) & (F.pmod(F.floor(scaled / 10), F.lit(2)) == 0)
        down = F.format_string("%.8f", F.signum(d) * (F.abs(d) - F.lit(2e-9)))
        return F.when(half & (F.abs(d) < 1e6), down).otherwise(text)

    return F.concat(F.lit("["), F.array_join(F.transform(v, literal), ","), F.lit("]"))


def slices(text: Column, size: int = 48) -> Column:
    """Array of consecutive pieces of `size` code points; empty for null and ''."""
    last = F.floor((F.length(text) - 1) / size)
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def redact_credentials(message: Column, size: int = 160) -> Column:
    """Connection strings and passwords masked, cut to `size`."""
    m = F.regexp_replace(message, r"(?i)\b([a-z][a-z0-9+.-]*://)[^\s@/]+@", "$1***@")
    return F.substring(F.regexp_replace(m, r"(?i)(password|passwd|pwd)\s*=\s*\S+", "$1=***"), 1, size)


def echo_gap(text: Column) -> Column:
    """Pause in milliseconds after a recited line: 2400 + 240 per code point, within 3200..9000."""
    return F.least(F.lit(9000), F.greatest(F.lit(3200), 2400 + 240 * F.length(text)))


def iso_now() -> Column:
    """The moment of the query in UTC, ISO 8601; keep it out of fingerprints."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
