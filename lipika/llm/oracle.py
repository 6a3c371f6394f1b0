"""DuckDB statements equal to the queries that SQL can express on whole tables.

The others (canonical form, language, scans, truncation, packing) are tested against brute force in tests/llm."""

from __future__ import annotations

_WS = r"\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


_SITE = f"""nullif(regexp_replace(regexp_extract({_strip('lower(source_url)')}, '^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\\.', ''), '')"""
_FORM = f"""regexp_replace(lower(trim(regexp_replace(line, '[{_WS}]+', ' ', 'g'))), '[0-9]+', '#', 'g')"""
_REPEATED = f"""WITH d AS (SELECT doc_id, {_SITE} AS site, string_split(text, chr(10)) AS lines FROM documents WHERE {_SITE} IS NOT NULL),
l AS (SELECT doc_id, site, unnest(range(1, len(lines) + 1))::INT AS line_no, unnest(lines) AS line FROM d),
f AS (SELECT doc_id, site, line_no, {_FORM} AS form FROM l),
g AS (SELECT doc_id, site, line_no, form FROM f WHERE length(form) >= 20),
n AS (SELECT site, form, count(DISTINCT doc_id) AS docs FROM g GROUP BY ALL), s AS (SELECT site, count(*) AS site_docs FROM d GROUP BY ALL),
over AS (SELECT site, form FROM n JOIN s USING (site) WHERE docs >= 5 AND docs >= site_docs * 0.1)
"""

# The tokens of each distinct word by repeated longest prefix, then of each document.
_TOKENS = f"""WITH RECURSIVE w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[{_WS}]+')) AS word FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, word, count(*) AS k FROM w WHERE word <> '' GROUP BY ALL),
v AS (SELECT DISTINCT starts_with(piece, '##') AS inside, CASE WHEN starts_with(piece, '##') THEN piece[3:] ELSE piece END AS p FROM tokenizer_vocab WHERE piece IS NOT NULL AND length(piece) > CASE WHEN starts_with(piece, '##') THEN 2 ELSE 0 END),
t(word, pos, n) AS (
  SELECT DISTINCT word, 1::BIGINT, 0 FROM u
  UNION ALL
  SELECT word, pos + coalesce((SELECT max(length(p)) FROM v WHERE inside = (pos > 1) AND starts_with(substr(word, pos), p)), 1), n + 1 FROM t WHERE pos <= length(word)),
c AS (SELECT word, max(n) AS n FROM t GROUP BY word),
tokens AS (SELECT doc_id, coalesce(sum(k * n), 0)::BIGINT AS tokens FROM documents LEFT JOIN (u JOIN c USING (word)) USING (doc_id) GROUP BY doc_id)
"""
# The mix: complete epochs, then the smallest exponential keys up to the budget that is left.
_MIXED = f"""{_TOKENS}, s AS (SELECT source, sum(tokens) AS have FROM documents JOIN tokens USING (doc_id) GROUP BY 1),
plan AS (SELECT m.source, target_share, max_repeats, coalesce(have, 0) AS have, target_share * (SELECT sum(tokens) FROM tokens)::DOUBLE AS want FROM mix_targets m LEFT JOIN s USING (source)),
epochs AS (SELECT *, least(floor(want / nullif(have, 0)), max_repeats)::BIGINT AS epochs FROM plan),
budget AS (SELECT *, CASE WHEN epochs >= max_repeats THEN 0 ELSE want - epochs * have END AS rest FROM epochs),
keyed AS (SELECT doc_id, source, t.tokens, -ln((('0x' || md5(concat('0:', doc_id::VARCHAR))[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / greatest(length(translate(text, '0123456789|<>#/[]', ''))::DOUBLE / greatest(length(text), 1), 0.01) AS key FROM documents JOIN tokens t USING (doc_id)),
mixed AS (SELECT doc_id, source, tokens, epochs + (key IS NOT NULL AND sum(tokens) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) <= rest)::INT AS repeats FROM keyed JOIN budget USING (source))
"""
_CODE = _strip("lower(regexp_extract(language, '^([^-_]*)', 1))")


def oracle_sql() -> dict[str, str]:
    """Name to SQL."""
    sql = {}
    sql["p4_found"] = f"{_REPEATED} SELECT doc_id, line_no FROM g JOIN over USING (site, form)"
    sql["p4_cleaned"] = f"""{_REPEATED}, gone AS (SELECT doc_id, list(line_no) AS gone FROM g JOIN over USING (site, form) GROUP BY 1)
SELECT doc_id, array_to_string(list_filter(lines, lambda x, i: NOT list_contains(gone, i::INT)), chr(10)) AS text, len(gone)::INT AS removed FROM d JOIN gone USING (doc_id)"""
    sql["p4_incremental"] = sql["p4_cleaned"]
    tradition = _strip("lower(tradition)")
    sql["p2_budget"] = f"""{_TOKENS} SELECT coalesce(nullif({_strip('source')}, ''), 'unknown') AS source, coalesce(CASE WHEN {_CODE} NOT IN ('', 'und', 'unknown') THEN {_CODE} END, 'und') AS language,
 CASE WHEN tradition IS NULL OR {tradition} IN ('', 'unknown') THEN 'unknown' ELSE {tradition} END AS tradition, count(*) AS documents, sum(length(coalesce(text, '')))::BIGINT AS characters, sum(tokens)::BIGINT AS tokens
FROM documents JOIN tokens USING (doc_id) GROUP BY 1, 2, 3"""
    sql["p8_found"] = f"{_TOKENS} SELECT doc_id FROM tokens WHERE tokens > 1024"
    sql["p9_found"] = f"""{_TOKENS}, s AS (SELECT source, sum(tokens) AS have FROM documents JOIN tokens USING (doc_id) GROUP BY 1)
SELECT m.source FROM mix_targets m LEFT JOIN s USING (source) WHERE max_repeats * coalesce(have, 0) < target_share * (SELECT sum(tokens) FROM tokens)"""
    sql["p9_mix"] = f"""{_MIXED} SELECT doc_id, source, tokens, repeats FROM mixed"""
    sql["p9_shares"] = f"""{_MIXED}, got AS (SELECT source, sum(tokens * repeats)::BIGINT AS mixed_tokens FROM mixed GROUP BY 1)
SELECT source, target_share, max_repeats, have::BIGINT AS source_tokens, want AS target_tokens, coalesce(mixed_tokens, 0)::BIGINT AS mixed_tokens, coalesce(mixed_tokens, 0)::DOUBLE / nullif(sum(mixed_tokens) OVER (), 0)::DOUBLE AS actual_share, max_repeats * have < want AS capped
FROM plan LEFT JOIN got USING (source)"""
    sql["p5_found"] = """WITH e AS (SELECT chunk_id, arg_max(embedding, created_at)::DOUBLE[] AS v FROM chunk_embeddings WHERE model_name = 'mini-multi-64'
  AND coalesce(len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)), false) GROUP BY chunk_id),
u AS (SELECT chunk_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))::DOUBLE[64] AS v FROM e),
p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, array_inner_product(a.v, b.v) AS s FROM u a JOIN u b ON a.chunk_id <> b.chunk_id),
k AS (SELECT a, b, s FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT x.a AS chunk_a, x.b AS chunk_b FROM k x JOIN k y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b AND x.s >= 0.9"""
    return sql
