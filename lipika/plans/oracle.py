"""DuckDB statements equal to the core queries, written independently of the Spark plans."""

from __future__ import annotations

from lipika.functions import fixed
from lipika.functions.sanskrit import tokenize
from lipika.operators import catalog, dedupe
from lipika.plans.queries import GOLD, MODEL, QUESTIONS, SIZE

_WS = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _flat(x: str) -> str:
    return _strip(f"regexp_replace({x}, '[{_WS}]+', ' ', 'g')")


def _label(c: str, missing: str) -> str:
    return f"lower(coalesce(nullif({c}, ''), '{missing}'))"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SIZE = "coalesce(nullif(n_chars, 0), length(text), 0)"
_PREFIX = "CASE work " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.WORK_PREFIX.items()) + " ELSE upper(work)[1:2] END"
_BLOB = "lower(concat(coalesce(title, ''), ' ', coalesce(source_url, '')))"
_WORK = f"""CASE
  WHEN contains({_BLOB}, 'atharva') OR regexp_matches({_BLOB}, '\\bav\\s+\\d{{1,2}}\\.\\d{{1,3}}\\b') THEN 'atharvaveda'
  WHEN regexp_matches({_BLOB}, 'yajur|vajasaneyi|vajasneyi|mādhyandina|madhyandina|\\bvs\\s+\\d{{1,2}}\\b') THEN 'yajurveda'
  WHEN regexp_matches({_BLOB}, 'samaveda|sama-veda|sāmaveda|hymns of the sama|\\bsv\\s+\\d{{1,2}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\b') THEN 'samaveda'
  WHEN regexp_matches({_BLOB}, 'rigveda|rig veda|ṛgveda|\\brv\\s+\\d{{1,2}}\\.\\d{{1,3}}\\b|rv\\d{{5}}\\.html?') THEN 'rigveda'
  WHEN (contains({_BLOB}, 'yoga') AND regexp_matches({_BLOB}, 'sutra|sūtra|patanjali|patañjali')) OR (lower(coalesce(tradition, '')) = 'yoga' AND contains({_BLOB}, 'sutra')) THEN 'yoga-sutra'
  WHEN regexp_matches({_BLOB}, 'bhagavad|song celestial|(^|[^\\pL\\pN_])g[iī]t[aā]($|[^\\pL\\pN_\\pM])') THEN 'bhagavad-gita' END"""
_USABLE = f"(len(embedding) = {SIZE} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)))"
_CURRENT = f"""cur AS (SELECT chunk_id, arg_max(embedding, created_at)::DOUBLE[] AS v FROM chunk_embeddings WHERE model_name = '{MODEL}' AND coalesce({_USABLE}, false) GROUP BY chunk_id),
vec AS (SELECT chunk_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM cur)"""

# Folding and tokens as the index has them, for texts in Latin and Devanagari.
_FOLD = "replace(lower(strip_accents(regexp_replace(regexp_replace({x}, '\\p{{Mn}}', '', 'g'), '\\p{{Mc}}', ' ', 'g'))), 'ß', 'ss')"
_META = "concat_ws(' ', nullif(title, ''), nullif(work, ''), nullif(locator, ''), nullif(heading, ''))"


def _wide(x: str) -> str:
    """Full-width signs and letters as their narrow forms, ligatures as their letters, the long s as s."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    narrow = f"translate({x}, {_quote(wide + 'ſ')}, {_quote(''.join(chr(ord(c) - 0xFEE0) for c in wide) + 's')})"
    for ligature, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        narrow = f"replace({narrow}, '{ligature}', '{letters}')"
    return narrow


def _folded(x: str) -> str:
    return _FOLD.format(x=_wide(x))


def _tokens(x: str) -> str:
    return "regexp_extract_all(" + _folded(x) + ", '[\\p{L}\\p{N}_]+')"


def _terms() -> str:
    rows = [
        f"('{q}', {p}, {a}, {_quote(term)})"
        for q, text in QUESTIONS.items()
        for p, t in enumerate(tokenize(text))
        for a, term in enumerate([t, *fixed.EXPANSIONS.get(t, [])])
        if a == 0 or tokenize(term) == [term]
    ]
    return f"terms(query_id, pos, alt, term) AS (VALUES {', '.join(rows)})"


_TOKENIZED = f"""WITH {_terms()},
one AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY created_at, doc_id) = 1),
tok AS (SELECT chunk_id, doc_id, title, locator, heading, text, CASE WHEN {_META} <> '' THEN list_concat(list_concat({_tokens(_META)}, {_tokens(_META)}), {_tokens("coalesce(text, '')")}) ELSE {_tokens("coalesce(text, '')")} END AS t FROM one),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
tf AS (SELECT chunk_id, greatest(len(t), 1) AS dl, term, count(*) AS tf FROM (SELECT chunk_id, t, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
"""


def _ranked(b: float = 0.75, name: str = "ranked") -> str:
    """Ranks by BM25 with the given regard to length."""
    return f"""{name}_part AS (SELECT query_id, pos, alt, chunk_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * ({1 - b} + {b} * dl / avgdl)) AS part FROM tf JOIN df USING (term) JOIN terms USING (term), stats),
{name}_best AS (SELECT query_id, chunk_id, pos, arg_min(part, alt) AS part FROM {name}_part GROUP BY ALL),
{name}_scores AS (SELECT query_id, chunk_id, round(sum(part), 6) AS score FROM {name}_best GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {name}_scores)"""


_BM25 = f"{_TOKENIZED}{_ranked()}"
# Two rankings, with and without regard to length.
_LISTS = f"""{_BM25}, {_ranked(0.0, "flat")},
l AS (SELECT query_id, 0 AS list, chunk_id, rank::INT AS rank FROM ranked WHERE rank <= 50 UNION ALL SELECT query_id, 1, chunk_id, rank::INT FROM flat WHERE rank <= 50)"""
_LINE = f"concat(coalesce(nullif(id, ''), nullif(source_url, ''), nullif(title, ''), ''), '|', coalesce(nullif(fingerprint, ''), sha256({_flat("lower(coalesce(text, ''))")})))"


def _verse_cover() -> str:
    return f"""WITH req AS (SELECT DISTINCT verse_id AS asked, string_split({_strip('verse_id')}, '.') AS p FROM chunks WHERE verse_id IS NOT NULL),
num AS (SELECT asked, upper(p[1]) AS prefix, list_transform(p[2:], lambda t: TRY_CAST(regexp_replace(t, '^[pP]', '') AS INT)) AS n FROM req WHERE len(p) >= 2 AND list_bool_and(list_transform(p[2:], lambda t: regexp_full_match(t, '[pP]?[0-9]+')))),
want AS (
  SELECT asked, CASE prefix {" ".join(f"WHEN '{v}' THEN '{k}'" for k, v in fixed.WORK_PREFIX.items())} END AS work,
    CASE WHEN prefix = 'SV' THEN n[1] * 100 + n[2] ELSE n[1] END AS book,
    CASE WHEN prefix IN ('RV', 'AV') THEN n[2] WHEN prefix = 'SV' THEN n[3] * 1000 + n[4] END AS hymn,
    CASE WHEN prefix IN ('RV', 'AV') THEN n[3] WHEN prefix = 'SV' THEN n[5] ELSE n[2] END AS target
  FROM num WHERE len(n) >= CASE WHEN prefix IN ('RV', 'AV') THEN 2 WHEN prefix = 'SV' THEN 4 ELSE 1 END),
hit AS (
  SELECT asked, c.*, coalesce(c.verse_id = asked, false) AS exact FROM want w JOIN chunks c ON c.work IS NOT NULL AND w.work IS NOT NULL AND (c.verse_id = asked
    OR (c.work = w.work AND c.book IS NOT DISTINCT FROM w.book AND c.hymn IS NOT DISTINCT FROM w.hymn AND (target IS NULL OR target BETWEEN c.verse AND coalesce(c.verse_end, c.verse))))),
top AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY doc_id, chunk_index, chunk_id) AS rank FROM hit QUALIFY rank <= 60)
"""


def oracle_sql() -> dict[str, str]:
    """Name to SQL."""
    sql = {}
    sql["flt_source_gate"] = f"""SELECT title, url, CASE WHEN {_strip("lower(coalesce(license, ''))")} = '' THEN 'license missing'
 WHEN {_strip("lower(license)")} NOT IN ('public-domain', 'cc0', 'cc-by', 'cc-by-sa', 'odbl', 'authorized', 'official-api', 'gov-ind') THEN 'license not allowed'
 WHEN {_strip("coalesce(url, '')")} = '' THEN 'url missing' WHEN download IS NOT DISTINCT FROM false THEN 'catalogue only' ELSE 'ok' END AS reason FROM manifest_sources"""
    sql["prj_records"] = f"""WITH d AS (SELECT *, sha256({_flat('lower(text)')}) AS fp FROM documents)
SELECT sha256(concat(coalesce(source_url, ''), '|', coalesce(title, ''), '|', fp[1:16]))[1:24] AS id, fp AS fingerprint, {_label('tradition', 'unknown')} AS tradition, {_label('language', 'und')} AS language, lower(license) AS license, length(text)::INT AS char_count FROM d"""
    flat = _flat("coalesce(text, '')")
    sql["prj_summaries"] = f"""SELECT id, doc_id, coalesce(nullif(title, ''), '') AS title, {_label('tradition', 'unknown')} AS tradition, {_label('language', 'und')} AS language, coalesce(license, '') AS license, {_SIZE} AS char_count,
 coalesce(nullif(work, ''), {_WORK}) AS work, CASE WHEN length({flat}) > 280 THEN concat({flat}[1:279], '…') ELSE {flat} END AS preview FROM documents"""
    sql["txt_normalized"] = f"""SELECT doc_id, md5({_strip("regexp_replace(regexp_replace(regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g'), '[ ' || chr(9) || ']+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")}) AS digest FROM documents"""
    sql["flt_devanagari"] = """SELECT doc_id, len(regexp_extract_all(text, '[\\x{900}-\\x{97F}]'))::INT AS letters FROM documents WHERE regexp_matches(text, '[\\x{900}-\\x{97F}]')"""
    sql["txt_urls"] = """WITH d AS (SELECT doc_id, source_url AS u, regexp_extract(source_url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS p, lower(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1)) AS h FROM documents WHERE source_url IS NOT NULL)
SELECT doc_id, lower(p) IN ('http', 'https') AND h <> '' AND NOT regexp_full_match(h, 'localhost|.*\\.local|.*\\.internal|127\\..*|10\\..*|192\\.168\\..*|169\\.254\\..*|0\\..*|172\\.(1[6-9]|2[0-9]|3[01])\\..*') AS public,
 coalesce(nullif(regexp_extract(lower(regexp_replace(u, '[?#].*$', '')), '\\.(pdf|epub|html?|txt|json|xml|xlsx)$'), ''), '.bin') AS extension,
 regexp_replace(regexp_replace(u, '^https?://(?:www\\.)?sacred-texts\\.com/', 'https://archive.sacred-texts.com/'), '[^A-Za-z0-9._-]+', '_', 'g')[1:80] AS name FROM d"""
    base = f"""CASE WHEN work IN ('rigveda', 'atharvaveda') THEN concat({_PREFIX}, ' ', coalesce(book::VARCHAR, 'None'), '.', coalesce(hymn::VARCHAR, 'None'))
 WHEN work = 'samaveda' THEN concat_ws('.', 'SV ' || (coalesce(book, 0) // 100), coalesce(book, 0) % 100, coalesce(hymn, 0) // 1000, coalesce(hymn, 0) % 1000) WHEN work IN ('bhagavad-gita', 'yajurveda', 'yoga-sutra') THEN concat({_PREFIX}, ' ', coalesce(book::VARCHAR, 'None')) END"""
    sql["txt_verse_ids"] = f"""SELECT chunk_id, CASE WHEN work IN ('rigveda', 'atharvaveda') THEN concat_ws('.', {_PREFIX}, coalesce(book, 0), coalesce(hymn, 0), verse)
 WHEN work = 'samaveda' THEN concat_ws('.', 'SV', coalesce(book, 0) // 100, coalesce(book, 0) % 100, coalesce(hymn, 0) // 1000, coalesce(hymn, 0) % 1000, verse)
 WHEN work IN ('bhagavad-gita', 'yajurveda') THEN concat_ws('.', {_PREFIX}, coalesce(book, 0), verse) WHEN work = 'yoga-sutra' THEN concat_ws('.', 'YS', coalesce(book, 0), coalesce(verse, 0)) ELSE {_PREFIX} END AS made_id,
 CASE WHEN ({base}) IS NULL THEN {_PREFIX} WHEN verse IS NULL THEN {base} WHEN verse_end IS NOT NULL AND verse_end <> verse THEN concat({base}, '.', verse, '–', verse_end) ELSE concat({base}, '.', verse) END AS made_locator
FROM (SELECT DISTINCT chunk_id, work, book, hymn, verse, verse_end FROM chunks WHERE work IS NOT NULL)"""
    sql["txt_parsed_ids"] = f"""{_verse_cover().split("hit AS (")[0].rstrip().rstrip(",")}
SELECT c.verse_id, w.work, CASE WHEN w.work IS NOT NULL THEN w.book END::INT AS book, CASE WHEN w.work IS NOT NULL THEN w.hymn END::INT AS hymn, CASE WHEN w.work IS NOT NULL THEN w.target END::INT AS verse
FROM (SELECT DISTINCT verse_id FROM chunks WHERE verse_id IS NOT NULL) c LEFT JOIN want w ON c.verse_id = w.asked"""
    loc, tit = (f"nullif({_strip(f"coalesce({c}, '')")}, '')" for c in ("locator", "title"))
    sql["txt_citations"] = f"SELECT coalesce({loc} || ' — ' || {tit}, {loc}, {tit}, 'fonte') AS label, count(*) AS chunks FROM chunks GROUP BY 1"
    sql["txt_slices"] = """SELECT chunk_id, chunk_index, ((length(text) - 1) // 48 + 1)::BIGINT AS pieces, substr(text, ((length(text) - 1) // 48) * 48 + 1, 48) AS last FROM (SELECT DISTINCT chunk_id, chunk_index, text FROM chunks WHERE length(text) > 0)"""
    sql["txt_vector_literals"] = f"""SELECT chunk_id, epoch_us(created_at) AS at, md5('[' || array_to_string(list_transform(embedding, lambda x: printf('%.8f', x::DOUBLE)), ',') || ']') AS digest FROM chunk_embeddings WHERE model_name = '{MODEL}' AND coalesce({_USABLE}, false)"""
    grouped = f"SELECT {{facet}} AS facet, {{value}} AS value, count(*) AS documents, coalesce(sum({_SIZE}), 0)::BIGINT AS characters FROM documents"
    sql["agg_stats"] = " UNION ALL ".join([grouped.format(facet=f"'{c}'", value=_label(c, m)) + " GROUP BY 2" for c, m in (("tradition", "unknown"), ("language", "und"))] + [grouped.format(facet="'all'", value="''")])
    sql["agg_raw_stats"] = "SELECT tradition, language, count(*) AS documents, count(*) FILTER (contains(lower(coalesce(title, '')), 'rigveda rv') OR contains(lower(coalesce(source_url, '')), '/rigveda/')) AS hymns FROM documents GROUP BY 1, 2"
    sql["agg_facets"] = " UNION ALL ".join(f"SELECT '{c}' AS facet, {c} AS value, count(*) AS documents FROM documents WHERE coalesce({c}, '') <> '' GROUP BY 2" for c in ("tradition", "language"))
    values = ", ".join(f"({i}, '{t}')" for i, t in enumerate(catalog.TRADITIONS, 1))
    sql["agg_traditions"] = f"SELECT position::INT AS position, t.tradition, count(d.doc_id) AS documents FROM (VALUES {values}) t(position, tradition) LEFT JOIN documents d ON {_strip('lower(d.tradition)')} = t.tradition GROUP BY 1, 2"
    sql["agg_table_counts"] = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in ("documents", "chunks", "chunk_embeddings"))
    summary = f"SELECT count(*) AS documents, coalesce(sum({_SIZE}), 0)::BIGINT AS characters, {', '.join(f'count(DISTINCT lower({c})) AS {c}s' for c in ('tradition', 'language', 'work'))} FROM documents"
    sql["agg_summary"] = summary
    sql["agg_fingerprint"] = f"SELECT CASE WHEN count(*) > 0 THEN sha256(string_agg({_LINE}, chr(10) ORDER BY {_LINE})) ELSE '' END AS fingerprint FROM documents"
    sql["agg_bucket_fingerprint"] = f"""WITH l AS (SELECT {_LINE} AS line FROM documents),
b AS (SELECT md5(line)[1:4] AS bucket, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM l GROUP BY 1)
SELECT CASE WHEN count(*) > 0 THEN sha256(string_agg(digest, chr(10) ORDER BY bucket)) ELSE '' END AS fingerprint FROM b"""
    checks = {"id missing": "coalesce(id, '') = ''", "text missing": "coalesce(text, '') = ''", "size wrong": "coalesce(n_chars, -1) <> length(coalesce(text, ''))", "license missing": "coalesce(license, '') = ''", "language missing": "coalesce(language, '') = ''"}
    sql["agg_expectations"] = " UNION ALL ".join(f"SELECT '{k}' AS \"check\", count(*) FILTER ({c}) AS failures FROM documents" for k, c in checks.items())
    sql["agg_profiles"] = """WITH n AS (SELECT count(*) AS d FROM documents), b(profile, low, high, expected) AS (VALUES ('tiny', NULL, 100, NULL), ('some', 101, NULL, NULL), ('many', 5000, NULL, NULL), ('exact', NULL, NULL, 1054)),
i AS (SELECT profile, CASE WHEN d < low THEN 'too few documents' WHEN d > high THEN 'too many documents' WHEN d <> expected THEN 'not the expected number' END AS issue FROM n, b)
SELECT profile, issue IS NULL AS ok, coalesce(issue, '') AS issue FROM i"""
    sql["agg_embedding_quality"] = f"SELECT model_name, count(*) AS rows, count(*) FILTER (coalesce({_USABLE}, false)) AS usable FROM chunk_embeddings GROUP BY 1"
    sql["agg_metrics"] = "SELECT event_type, user_id % 10 AS user_group, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
    sql["agg_exposition"] = """SELECT concat('events_total{event_type="', event_type, '"} ', count(*)) AS line FROM events GROUP BY event_type"""
    sql["top_total"] = "SELECT count(*) AS total FROM documents WHERE lower(language) = 'en' AND contains(lower(concat(coalesce(title, ''), ' ', coalesce(substr(text, 1, 4000), ''), ' ', coalesce(source_url, ''))), 'ocean')"
    sql["snk_synced"] = """WITH t AS (SELECT url, language FROM manifest_sources QUALIFY row_number() OVER (PARTITION BY url ORDER BY title NULLS FIRST, language NULLS FIRST) = 1)
SELECT 'synced' AS counter, count(*) FILTER (language = 'en') AS value FROM t UNION ALL SELECT 'purged', count(*) FILTER (language IS DISTINCT FROM 'en') FROM t"""
    sql["snk_replaced"] = """WITH c AS (SELECT DISTINCT doc_id, chunk_id, chunk_index FROM chunks), g AS (SELECT doc_id FROM documents WHERE retrieved_at >= TIMESTAMP '2025-01-01')
SELECT * FROM c WHERE doc_id NOT IN (SELECT doc_id FROM g) UNION ALL SELECT doc_id, 'new-' || chunk_id, chunk_index FROM c WHERE chunk_index = 0 AND doc_id IN (SELECT doc_id FROM g)"""
    sql["set_preferred"] = "SELECT doc_id, book, hymn, source_url FROM documents WHERE source_url IS NOT NULL AND book IS NOT NULL AND hymn IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book, hymn ORDER BY length(source_url) DESC, doc_id) = 1"
    sql["top_page"] = "SELECT doc_id, title, language FROM documents WHERE lower(language) = 'en' AND contains(lower(concat(coalesce(title, ''), ' ', coalesce(substr(text, 1, 4000), ''), ' ', coalesce(source_url, ''))), 'ocean') ORDER BY doc_id LIMIT 25 OFFSET 10"
    sql["top_lookup"] = "SELECT doc_id, id, title FROM documents WHERE id = (SELECT min(id) FROM documents) ORDER BY doc_id LIMIT 1"
    sql["win_chunks"] = f"""WITH RECURSIVE d AS (SELECT doc_id, {_strip('text')} AS t FROM documents WHERE text IS NOT NULL),
w(doc_id, t, a, e) AS (
  SELECT doc_id, t, 0, CASE WHEN length(t) > 800 AND k > 266 THEN k ELSE least(800, length(t)) END FROM (SELECT doc_id, t, length(regexp_extract(substr(t, 1, 800), '^(?s:(.*))[ \\n]', 1)) AS k FROM d WHERE length(t) > 0)
  UNION ALL
  SELECT doc_id, t, s, CASE WHEN length(t) > s + 800 AND k > 266 THEN s + k ELSE least(s + 800, length(t)) END FROM (
    SELECT doc_id, t, CASE WHEN e - 120 > a THEN e - 120 ELSE e END AS s, length(regexp_extract(substr(t, CASE WHEN e - 120 > a THEN e - 120 ELSE e END + 1, 800), '^(?s:(.*))[ \\n]', 1)) AS k FROM w WHERE e < length(t))),
p AS (SELECT doc_id, a, {_strip('substr(t, a + 1, e - a)')} AS piece FROM w)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::INT AS chunk_index, md5(piece) AS digest, length(piece)::INT AS char_count FROM p WHERE piece <> ''"""
    work = "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(title, '')), {_quote(p)}) THEN '{w}'" for w, p in dedupe.SAMPLE_WORKS) + " END"
    sql["joi_superseded"] = f"""WITH d AS (SELECT doc_id, {work} AS w, lower(coalesce(nullif(language, ''), 'en')) AS l, (trim(coalesce(source_url, '')) LIKE 'fixtures/%' OR contains(coalesce(source_url, ''), '/fixtures/')) AS s, length(coalesce(text, '')) AS n FROM documents),
b AS (SELECT w, l, max(n) AS best FROM d WHERE NOT s AND w IS NOT NULL GROUP BY 1, 2)
SELECT doc_id FROM d LEFT JOIN b USING (w, l) WHERE NOT (s AND w IS NOT NULL AND coalesce(best, 0) >= 3 * greatest(n, 1))"""
    sql["joi_cascade"] = """WITH d AS (SELECT doc_id FROM documents WHERE retrieved_at IS NOT NULL), c AS (SELECT * FROM chunks WHERE doc_id IN (SELECT doc_id FROM d))
SELECT chunk_id, '' AS model_name FROM c UNION ALL SELECT chunk_id, model_name FROM chunk_embeddings WHERE chunk_id IN (SELECT chunk_id FROM c)"""
    sql["snk_upsert"] = """WITH t AS (SELECT url, title, language, attribution FROM manifest_sources QUALIFY row_number() OVER (PARTITION BY url ORDER BY title NULLS FIRST, language NULLS FIRST) = 1)
SELECT url, CASE WHEN language = 'en' THEN upper(title) ELSE title END AS title, language, attribution FROM t"""
    sql["joi_current_vectors"] = f"WITH {_CURRENT} SELECT chunk_id, min(doc_id) AS doc_id, max(len(v))::INT AS size, round(any_value(v[1]), 5) AS first FROM chunks JOIN vec USING (chunk_id) GROUP BY 1"
    sql["top_vectors"] = f"WITH {_CURRENT}, q AS (SELECT v AS qv FROM vec ORDER BY chunk_id LIMIT 1) SELECT chunk_id, round(s, 4) AS score FROM (SELECT chunk_id, list_dot_product(v, qv) AS s FROM vec, q) ORDER BY s DESC, chunk_id LIMIT 20"
    sql["top_vectors_batch"] = f"""WITH {_CURRENT}, q AS (SELECT chunk_id AS query_id, v AS qv FROM vec ORDER BY chunk_id LIMIT 5)
SELECT query_id, chunk_id, round(s, 4) AS score FROM (SELECT query_id, chunk_id, list_dot_product(v, qv) AS s FROM vec, q) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) <= 10"""
    sql["agg_bm25"] = f"{_BM25} SELECT query_id, rank::INT AS rank, chunk_id, round(score, 3) AS score FROM ranked WHERE rank <= 10"
    sql["win_diversified"] = f"""{_BM25}, h AS (SELECT query_id, r.chunk_id, score, doc_id FROM ranked r JOIN tok USING (chunk_id) WHERE rank <= 200),
k AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_id) <= 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank, chunk_id, doc_id FROM k QUALIFY rank <= 10"""
    sql["win_fused"] = f"{_LISTS} SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM l GROUP BY ALL"
    sql["set_union"] = f"{_LISTS} SELECT query_id, list, chunk_id, rank FROM l QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY list, rank) = 1"
    gold = ", ".join(f"('{i}', {_quote(q)}, {m}, {e!r})" for i, q, m, e in GOLD)
    match = "list_bool_or(list_transform(expect, lambda p: contains(lower(coalesce(title, '')), lower(p))))"
    sql["evl_suite"] = f"""{_BM25}, gold(id, query, min_hits, expect) AS (VALUES {gold}), h AS (SELECT query_id AS id, title FROM ranked JOIN tok USING (chunk_id) WHERE rank <= 10)
SELECT id, count(title) AS hits, coalesce(bool_or({match}), false) AS matched, count(title) >= min_hits AND coalesce(bool_or({match}), false) AS ok FROM gold LEFT JOIN h USING (id) GROUP BY id, min_hits"""
    pairs = f"""{_BM25}, gold(query_id, query, min_hits, expect) AS (VALUES {gold}), h AS (SELECT query_id, rank, coalesce({match}, false) AS pos, title, text FROM ranked JOIN tok USING (chunk_id) JOIN gold USING (query_id) WHERE rank <= 40 AND {_strip("coalesce(text, '')")} <> ''),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id, pos ORDER BY rank) AS n FROM h QUALIFY pos OR n <= 8)"""
    sql["evl_pairs"] = f"""{pairs} SELECT query_id, rank::INT AS rank, pos::INT AS label, CASE WHEN pos THEN 'positive' ELSE 'negative' END AS pair_kind, 'train' AS split, coalesce(title, '') AS doc_title, md5(text) AS digest FROM p"""
    sql["evl_pair_summary"] = f"""{pairs} SELECT unnest(['train', 'all']) AS split, count(*) AS pairs, count(*) FILTER (pos) AS positives, count(*) FILTER (NOT pos) AS negatives, count(DISTINCT query_id) AS queries FROM p"""
    sql["evl_splits"] = """WITH i AS (SELECT DISTINCT url AS query_id FROM manifest_sources WHERE url IS NOT NULL), n AS (SELECT count(*) AS n FROM i), r AS (SELECT query_id, row_number() OVER (ORDER BY query_id DESC) AS rn, n FROM i, n)
SELECT query_id, CASE WHEN n >= 2 AND rn <= greatest(1, round_even(n * 0.2, 0)) THEN 'eval' ELSE 'train' END AS split FROM r"""
    books = ", ".join(f"({i}, {n})" for i, n in enumerate(fixed.HYMNS_PER_BOOK, 1))
    sql["src_hymn_manifest"] = f"SELECT 'mandala-' || b AS book, n::BIGINT AS hymns, printf('https://archive.sacred-texts.com/hin/rigveda/rv%02d%03d.htm', b, n) AS last FROM (VALUES {books}) t(b, n)"
    sql["joi_verse_cover"] = f"{_verse_cover()} SELECT asked, rank::INT AS rank, chunk_id, exact FROM top"
    sql["agg_witnesses"] = f"""{_verse_cover()}, r AS (SELECT *, CASE WHEN regexp_matches(lower(coalesce(title, '')), 'vedaweb|zürich|zurich|iso-15919') THEN 'iast' WHEN lower(language) = 'sa' THEN 'sa' WHEN lower(language) IN ('en', 'eng') THEN 'en' WHEN lower(language) LIKE 'pt%' THEN 'pt' WHEN coalesce(language, '') = '' THEN 'other' ELSE lower(language) END AS role FROM top),
f AS (SELECT asked, role, rank, coalesce(nullif(list_position(['sa', 'iast', 'en', 'pt'], role), 0), 99) AS place, language FROM r QUALIFY row_number() OVER (PARTITION BY asked, role ORDER BY exact DESC, rank) = 1)
SELECT asked, string_agg(role, ',' ORDER BY place, role, language NULLS FIRST) AS roles, bool_or(role = 'sa') AS has_sanskrit FROM f GROUP BY 1"""
    sql["par_padas"] = f"""WITH c AS (SELECT chunk_id, min(text) AS t FROM chunks WHERE lower(language) = 'sa' GROUP BY 1),
p AS (SELECT chunk_id, list_filter(list_transform(regexp_split_to_array(t, '[।॥|]+'), lambda x: {_strip('x')}), lambda x: x <> '' AND NOT regexp_matches(x, '[०-९]')) AS ps FROM c),
a AS (SELECT chunk_id, ps, list_position(list_transform(ps, lambda x: regexp_matches(x, '[\\x{{951}}\\x{{952}}]')), true) AS k FROM p),
s AS (SELECT chunk_id, CASE WHEN len(ps) > 1 AND k > 1 THEN ps[k:] ELSE ps END AS ps FROM a)
SELECT chunk_id, (unnest(range(1, len(ps) + 1)) - 1)::INT AS pos, unnest(ps) AS pada FROM s"""
    walk = """WITH RECURSIVE m AS (SELECT {middle} AS m), d AS (SELECT row_number() OVER (ORDER BY doc_id) AS rn, doc_id, nullif(fingerprint, '') AS f, nullif(source_url, '') AS u FROM documents, m WHERE doc_id > m.m),
w(rn, fs, us, kept) AS (
  SELECT 0::BIGINT, (SELECT coalesce(list(DISTINCT fingerprint), []) FROM documents, m WHERE doc_id <= m.m AND fingerprint <> ''), (SELECT coalesce(list(DISTINCT source_url), []) FROM documents, m WHERE doc_id <= m.m AND source_url <> ''), NULL::BIGINT
  UNION ALL
  SELECT rn, CASE WHEN seen OR f IS NULL THEN fs ELSE list_append(fs, f) END, CASE WHEN seen OR u IS NULL THEN us ELSE list_append(us, u) END, CASE WHEN NOT seen THEN doc_id END
  FROM (SELECT d.rn, d.doc_id, d.f, d.u, w.fs, w.us, coalesce(list_contains(w.fs, d.f), false) OR coalesce(list_contains(w.us, d.u), false) AS seen FROM w JOIN d ON d.rn = w.rn + 1))
SELECT kept AS doc_id FROM w WHERE kept IS NOT NULL"""
    sql["set_greedy"] = walk.format(middle="-1")
    sql["joi_new_records"] = walk.format(middle="(SELECT quantile_disc(doc_id, 0.5) FROM documents)")
    sql["str_rate_limit"] = """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
w(user_id, event_id, rn, start, n) AS (
  SELECT user_id, event_id, 1::BIGINT, ts, 1 FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.rn, CASE WHEN e.ts >= w.start + INTERVAL 1 DAY THEN e.ts ELSE w.start END, CASE WHEN e.ts >= w.start + INTERVAL 1 DAY THEN 1 ELSE w.n + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1)
SELECT event_id, user_id, epoch_us(start) AS started, n <= 2 AS allowed FROM w"""
    words = f"len(regexp_extract_all(text, '[^{_WS}]+'))"
    sql["ml_compression"] = f"SELECT count(*) AS documents, sum(length(text))::BIGINT AS characters, sum({words})::BIGINT AS tokens, round(sum(length(text))::DOUBLE / sum({words}), 3) AS ratio, round(sum({words})::DOUBLE / count(*), 2) AS average FROM documents WHERE text <> ''"
    host = lambda c: f"regexp_replace(lower(regexp_extract({c}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)), '^www\\.', '')"
    license_ = _strip("lower(coalesce(license, ''))")
    reason = f"CASE WHEN {license_} NOT IN ('public-domain', 'cc0', 'cc-by', 'cc-by-sa', 'odbl', 'authorized', 'official-api', 'gov-ind') OR {_strip("coalesce(url, '')")} = '' THEN 'license' WHEN download IS NOT DISTINCT FROM false THEN 'download' ELSE 'ok' END"
    sql["qry_ingest"] = f"""WITH d AS (SELECT {host('source_url')} AS h, arg_min(text, doc_id) AS text FROM documents WHERE text IS NOT NULL AND {host('source_url')} <> '' GROUP BY 1),
m AS (SELECT url, {reason} AS reason, CASE WHEN source_class IS DISTINCT FROM 'structured-json' OR json_valid(text) THEN text END AS text FROM manifest_sources LEFT JOIN d ON {host('url')} = h),
ok AS (SELECT *, text IS NOT NULL AND length(text) >= 80 AS long, sha256({_flat('lower(text)')}) AS fp FROM m WHERE reason = 'ok'),
first AS (SELECT count(*) AS n FROM (SELECT DISTINCT url, fp FROM ok WHERE long))
SELECT unnest(['total_sources', 'accepted', 'skipped_license', 'skipped_download_flag', 'failed', 'empty_or_short', 'duplicates', 'added']) AS counter,
 unnest([(SELECT count(*) FROM m), (SELECT count(*) FROM ok), (SELECT count(*) FROM m WHERE reason = 'license'), (SELECT count(*) FROM m WHERE reason = 'download'), (SELECT count(*) FROM ok WHERE text IS NULL),
  (SELECT count(*) FROM ok WHERE text IS NOT NULL AND NOT long), (SELECT count(*) FROM ok WHERE long) - (SELECT n FROM first), (SELECT n FROM first)]) AS value"""
    flat = _strip("regexp_replace(regexp_replace(regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g'), '[ ' || chr(9) || ']+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")
    sql["jsn_records"] = f"""WITH v AS (SELECT work, book, CASE WHEN work <> 'bhagavad-gita' THEN hymn END AS hymn, hymn AS own, verse, min({flat}) AS t FROM chunks WHERE work IN ('rigveda', 'atharvaveda', 'bhagavad-gita') AND book IS NOT NULL AND verse IS NOT NULL AND text IS NOT NULL AND (work = 'bhagavad-gita' OR hymn IS NOT NULL) GROUP BY ALL HAVING min({flat}) <> ''),
r AS (SELECT work, book, hymn, CASE WHEN work = 'bhagavad-gita' THEN concat('CHAPTER ', book, ' — Sanskrit (DharmicData)', chr(10), chr(10), string_agg(concat(book, '.', verse, ' ', t), chr(10) || chr(10) ORDER BY verse), chr(10))
 ELSE concat('HYMN ', book, '.', hymn, chr(10), chr(10), string_agg(concat(verse, '. ', t), chr(10) || chr(10) ORDER BY verse), chr(10)) END AS text FROM v GROUP BY work, book, hymn, own),
n AS (SELECT text, CASE work WHEN 'rigveda' THEN 'Rigveda RV ' WHEN 'atharvaveda' THEN 'Atharvaveda AV ' ELSE 'Bhagavad-gītā ' END || concat_ws('.', book, hymn) || ' (Sanskrit, DharmicData)' AS title,
 'https://github.com/bhavykhatri/DharmicData/blob/main/' || CASE work WHEN 'rigveda' THEN concat('Rigveda/rigveda_mandala_', book, '.json#sukta-', hymn) WHEN 'atharvaveda' THEN concat('AtharvaVeda/atharvaveda_kaanda_', book, '.json#sukta-', hymn) ELSE concat('SrimadBhagvadGita/bhagavad_gita_chapter_', book, '.json') END AS source_url,
 CASE WHEN work = 'bhagavad-gita' THEN 'vaishnava' ELSE 'vedic' END AS tradition, sha256({_flat('lower(text)')}) AS fingerprint FROM r)
SELECT sha256(concat(source_url, '|', title, '|', fingerprint[1:16]))[1:24] AS id, title, source_url, tradition, 'sa' AS language, 'cc0' AS license, length(text)::INT AS char_count, fingerprint FROM n"""
    return sql
