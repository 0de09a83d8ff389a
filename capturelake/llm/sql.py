"""SQL of the queries on duplicates, survivors, leaks and length limits; endings and token ids have none that is practical."""

from __future__ import annotations

from capturelake.plans.problem_sql import addressed, with_utc


def _copies(name: str, row_id: str, column: str, others: list[str]) -> str:
    keys = ", ".join(["addr", *others])
    return (
        f"SELECT '{name}' AS table_name, first_id, {row_id} AS copy_id FROM (SELECT *, min({row_id}) OVER (PARTITION BY {keys}) AS first_id "
        f"FROM {addressed(name, column)} x WHERE addr IS NOT NULL) y WHERE {row_id} <> first_id"
    )


_FIELDS = [("cdx_records", "id", "url", ["timestamp", "source"]), ("link_graph", "id", "target_url", ["source_url", "source_timestamp"]), ("discoveries", "discovery_id", "url", [])]
P3 = " UNION ALL ".join(_copies(*f) for f in _FIELDS)
P3_COLLAPSED = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, min({i}) AS first_id, count(*) AS copies FROM {addressed(n, c)} x WHERE addr IS NOT NULL GROUP BY {', '.join(['addr', *o])}" for n, i, c, o in _FIELDS
)

_RANK = "confidence DESC NULLS LAST, utc DESC NULLS LAST, hit_id"
P6 = f"""
WITH h AS (SELECT * FROM {addressed(with_utc('archive_hits', 'archive'), 'url')} x WHERE addr IS NOT NULL)
SELECT min(hit_id) AS group_hit_id, first(hit_id ORDER BY {_RANK}) AS top_hit_id, coalesce(first(hit_id ORDER BY {_RANK}) FILTER (size > 0), 0) AS size_hit_id,
coalesce(first(hit_id ORDER BY {_RANK}) FILTER (utc IS NOT NULL), 0) AS timestamp_hit_id FROM h GROUP BY addr HAVING count(*) > 1
"""

_TEXTS = ("url", "archive", "status", "mimetype", "download_url")
_BEST = "first({0} ORDER BY " + _RANK + ") FILTER ({1}) AS {0}"
P6_FIELDS = f"""
WITH h AS (SELECT * REPLACE (CASE WHEN size > 0 THEN size END AS size, CASE WHEN NOT isnan(confidence) THEN confidence END AS confidence, {', '.join(f"CASE WHEN trim({c}, ' ') NOT IN ('', '-') THEN {c} END AS {c}" for c in _TEXTS)}), CAST(epoch(utc) AS BIGINT) AS instant
 FROM {addressed(with_utc('archive_hits', 'archive'), 'url')} x WHERE addr IS NOT NULL)
SELECT min(hit_id) AS group_hit_id, count(*) AS hits, {', '.join(_BEST.format(c, c + ' IS NOT NULL') for c in (*_TEXTS, 'size', 'confidence', 'instant'))}, {_BEST.format('timestamp', 'utc IS NOT NULL')} FROM h GROUP BY addr
"""

_INVISIBLE = r"[\x{00AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}]"
_PLAIN = "regexp_replace(text, '<!--.*?-->|</?[a-zA-Z][^<>]*>', ' ', 'g')"
for _entity, _char in (("&nbsp;", "' '"), ("&amp;", "'&'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&shy;", "''")):
    _PLAIN = f"replace({_PLAIN}, '{_entity}', {_char})"
_WORDS = f"list_filter(regexp_split_to_array(lower(nfc_normalize(regexp_replace({_PLAIN}, '{_INVISIBLE}', '', 'g'))), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def _runs(name: str, row_id: str) -> str:
    return (
        f"(SELECT DISTINCT {row_id}, array_to_string(w[k:k + 12], ' ') AS run FROM (SELECT {row_id}, w, unnest(range(1, len(w) - 11)) AS k FROM "
        f"(SELECT {row_id}, {_WORDS} AS w FROM {name} WHERE text IS NOT NULL) WHERE len(w) >= 13))"
    )


P9 = f"SELECT DISTINCT d.doc_id, i.item_id FROM {_runs('documents', 'doc_id')} d JOIN {_runs('eval_items', 'item_id')} i USING (run)"
P9_ITEMS = f"SELECT item_id, count(DISTINCT doc_id) AS documents FROM ({P9}) GROUP BY 1"

_COUNT = lambda pattern: f"len(regexp_extract_all(text, '{pattern}'))"
_LINES = "(length(text) - length(replace(text, chr(10), ''))) - (length(text) - length(replace(text, chr(13) || chr(10), ''))) // 2"
_ASTRAL, _QUOTES, _CONTROLS, _OTHERS = r"[\x{10000}-\x{10ffff}]", r'["\\]', r"[\n\r\t\x08\x0c]", r"[\x00-\x07\x0b\x0e-\x1f]"
_LENGTHS = {
    "characters": "length(text)", "utf8_bytes": "strlen(text)", "utf16_units": f"length(text) + {_COUNT(_ASTRAL)}",
    "html_characters": f"length(text) + 4 * {_COUNT('&')} + 3 * {_COUNT('[<>]')} + 5 * {_COUNT(chr(34))}",
    "json_characters": f"length(text) + {_COUNT(_QUOTES)} + {_COUNT(_CONTROLS)} + 5 * {_COUNT(_OTHERS)}",
    "crlf_characters": f"length(text) + {_LINES}", "crlf_bytes": f"strlen(text) + {_LINES}",
}
_BLANK_TEXT = r"[\s\x00-\x1f\x7f\x{85}\x{a0}\x{ad}\x{1680}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}]*"
P10_LIMITS = f"""
WITH t AS (SELECT DISTINCT source, text FROM documents WHERE NOT regexp_full_match(text, '{_BLANK_TEXT}')),
m AS ({' UNION ALL '.join(f"SELECT source, {k} AS k, '{n}' AS measure, {x} AS len FROM t" for k, (n, x) in enumerate(_LENGTHS.items()))}),
c AS (SELECT source, k, measure, len, count(*) AS n FROM m GROUP BY 1, 2, 3, 4),
s AS (SELECT *, sum(n) OVER (PARTITION BY source, measure) AS total FROM c),
l AS (SELECT s.*, (SELECT sum(n) FROM c WHERE c.source IS NOT DISTINCT FROM s.source AND c.measure = s.measure AND c.len // 32 BETWEEN s.len // 32 - 1 AND s.len // 32 + 1) AS near,
 (SELECT coalesce(sum(n), 0) FROM c WHERE c.source IS NOT DISTINCT FROM s.source AND c.measure = s.measure AND c.len BETWEEN s.len + 1 AND s.len + 8) AS beyond FROM s)
SELECT source, measure, len AS "limit", n AS texts, round(n / total, 6) AS share FROM l WHERE n >= 8 AND n >= 0.005 * total AND (near - n) * 10 <= n * 95 AND beyond * 10 <= n * 8
QUALIFY row_number() OVER (PARTITION BY source, len ORDER BY n DESC, k) = 1
"""

SQL = {"p3_found": P3, "p3_collapsed": P3_COLLAPSED, "p6_found": P6, "p6_fields": P6_FIELDS, "p9_found": P9, "p9_items": P9_ITEMS, "p10_limits": P10_LIMITS}
