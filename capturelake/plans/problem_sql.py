"""SQL of the problem queries, written on its own: an independent statement of what they must give.

It states the forms that the test tables hold; the operators know more of them.
"""

from __future__ import annotations

_BLANK = r"[\s\x{0085}\x{00A0}\x{00AD}\x{1680}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{2064}\x{3000}\x{FEFF}\x00-\x1f]+"


def addressed(source: str, column: str) -> str:
    """Rows of ``source`` (a table or subquery) with ``addr``: the address of ``column``, NULL if there is none."""
    q = "'"
    return f"""(
WITH a0 AS (SELECT *, regexp_replace({column}, '{_BLANK}', '', 'g') AS t0 FROM {source}),
a1 AS (SELECT *, replace(replace(replace(replace(replace(replace(t0, '&amp;', '&'), '&quot;', '"'), '&apos;', {q}{q}{q}{q}), '&nbsp;', ''), '&lt;', '<'), '&gt;', '>') AS t1 FROM a0),
a2 AS (SELECT *, regexp_replace(lower(url_decode(regexp_replace(lower(t1), '%(2[1-9abcf]|3[a-f]|40|5[b-e]|60|7[b-df])', '%25\\1', 'g'))), '{_BLANK}', '', 'g') AS t2 FROM a1),
a3 AS (SELECT *, regexp_replace(regexp_replace(t2, '^[^a-z0-9]+', ''), '[]"{q}{q}`<>(){{}}[|,;:.!?#&*]+$', '') AS t3 FROM a2),
a4 AS (SELECT *, regexp_extract(t3, '^(https?):/+', 1) AS sch, regexp_replace(regexp_extract(t3, '^https?:/+([^/?#]*)', 1), '[.]*(:[0-9]*)?$', '\\1') AS h0,
 regexp_extract(t3, '^https?:/+[^/?#]*([^?#]*)', 1) AS p0, replace(regexp_extract(t3, '^https?:/+[^/?#]*[^?#]*[?]([^#]*)', 1), '+', '') AS q0, regexp_extract(t3, '#(.*)$', 1) AS f0 FROM a3),
a5 AS (SELECT *, regexp_replace(regexp_replace(h0, ':0*$', ''), CASE WHEN sch = 'http' THEN ':0*80$' ELSE ':0*443$' END, '') AS h1,
 regexp_replace(regexp_replace(regexp_replace(p0, '/([.]?/)+', '/', 'g'), '/[.]$', '/'), '/+$', '') AS p1, list_sort(list_filter(string_split(q0, '&'), lambda f: f NOT IN ('', '='))) AS fs FROM a4)
SELECT * EXCLUDE (t0, t1, t2, t3, sch, h0, p0, q0, f0, h1, p1, fs),
 CASE WHEN regexp_matches(t3, '^https?:/') AND regexp_matches(h1, '[^.:@]') THEN sch || '://' || h1 || p1 || CASE WHEN len(fs) > 0 THEN '?' || array_to_string(fs, '&') ELSE '' END || CASE WHEN f0 <> '' THEN '#' || f0 ELSE '' END END AS addr FROM a5)"""


def with_utc(source: str, zone_of: str | None) -> str:
    """Rows of ``source`` with ``utc``: the instant of ``timestamp``; ``zone_of`` names the column of the source, NULL means UTC."""
    zone = f"(SELECT z.zone FROM archive_sources z WHERE z.source = lower(regexp_replace(i0.{zone_of}, '^\\s+|\\s+$', '', 'g')))" if zone_of else "'UTC'"
    return f"""(
WITH i0 AS (SELECT * FROM {source}),
i1 AS (SELECT *, {zone} AS own FROM i0),
i2 AS (SELECT *, CASE
 WHEN regexp_full_match(timestamp, '[0-9]{{14}}([0-9]{{3}})?') THEN try_strptime(substr(timestamp, 1, 14), '%Y%m%d%H%M%S')
 WHEN regexp_matches(timestamp, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') THEN try_strptime(substr(timestamp, 1, 10) || ' ' || substr(timestamp, 12, 8), '%Y-%m-%d %H:%M:%S')
 WHEN regexp_matches(timestamp, '^[0-9]{{2}}/[A-Z][a-z]{{2}}/') THEN try_strptime(substr(timestamp, 1, 20), '%d/%b/%Y:%H:%M:%S')
 WHEN regexp_matches(timestamp, '^[A-Z][a-z]{{2}}, [0-9]') THEN try_strptime(substr(timestamp, 6, 20), '%d %b %Y %H:%M:%S')
 WHEN regexp_matches(timestamp, '^[A-Z][a-z]{{2}} [0-9]') THEN try_strptime(regexp_extract(timestamp, '^(.*[AP]M)', 1), '%b %d, %Y %I:%M:%S %p') END AS clock,
 CASE WHEN regexp_full_match(timestamp, '[0-9]+') THEN ''
 WHEN regexp_matches(timestamp, '^[0-9]{{4}}-') THEN trim(regexp_extract(timestamp, ':[0-9]{{2}}(?:[.][0-9]+)?(| ?[A-Z+-].*)$', 1))
 WHEN regexp_matches(timestamp, '^[0-9]{{2}}/') THEN substr(timestamp, 22)
 WHEN regexp_matches(timestamp, '^[A-Z][a-z]{{2}}, ') THEN substr(timestamp, 27) ELSE trim(regexp_extract(timestamp, '[AP]M(.*)$', 1)) END AS z,
 CASE WHEN regexp_full_match(timestamp, '[0-9]{{9,10}}') THEN CAST(timestamp AS BIGINT) WHEN regexp_full_match(timestamp, '[0-9]{{12,13}}') THEN CAST(timestamp AS BIGINT) // 1000 END AS sec FROM i1),
i3 AS (SELECT *, CASE WHEN z IN ('Z', 'GMT', 'UTC') THEN 0 WHEN z = 'EST' THEN -300 WHEN z = 'EDT' THEN -240 WHEN z = 'PST' THEN -480 WHEN z = 'PDT' THEN -420
 WHEN regexp_full_match(z, '[+-][0-9]{{2}}:?[0-9]{{2}}') THEN (CASE WHEN z[1] = '-' THEN -1 ELSE 1 END) * (CAST(substr(z, 2, 2) AS INT) * 60 + CAST(right(z, 2) AS INT)) END AS off,
 CASE WHEN z = '' THEN own WHEN contains(z, '/') THEN z END AS zn FROM i2),
i4 AS (SELECT *, timezone('UTC', timezone(zn, clock)) AS u0 FROM i3),
i5 AS (SELECT *, CASE WHEN timezone(zn, timezone('UTC', u0 - INTERVAL 1 HOUR)) = clock THEN u0 - INTERVAL 1 HOUR WHEN timezone(zn, timezone('UTC', u0)) = clock THEN u0 END AS u1 FROM i4)
SELECT * EXCLUDE (own, clock, z, sec, off, zn, u0, u1), CASE WHEN sec IS NOT NULL THEN to_timestamp(sec) AT TIME ZONE 'UTC' WHEN off IS NOT NULL THEN clock - to_minutes(off) ELSE u1 END AS utc FROM i5)"""


_CHAINS = with_utc("(SELECT url, lower(content_hash) AS h, timestamp FROM version_chains WHERE coalesce(content_hash, '') <> '')", None)
_STAMP = "strftime({}, '%Y%m%d%H%M%S')"

P2 = f"""
WITH s AS (SELECT DISTINCT url, {_STAMP.format('utc')} AS t, h FROM {_CHAINS} x WHERE utc IS NOT NULL AND url IS NOT NULL),
m AS (SELECT *, lag(h) OVER (PARTITION BY url ORDER BY t, h) AS p FROM s), f AS (SELECT url, t, h FROM m WHERE p IS NULL OR p <> h)
SELECT url, t AS valid_from, coalesce(lead(t) OVER (PARTITION BY url ORDER BY t, h), '99991231235959') AS valid_to FROM f
"""

_BOTH = "(SELECT 'cdx_records' AS table_name, domain, url, timestamp, source FROM cdx_records UNION ALL SELECT 'records', domain, url, timestamp, source FROM records)"

P1 = f"""
WITH b AS (SELECT table_name, domain, count(*) AS n FROM {_BOTH} GROUP BY 1, 2), t AS (SELECT table_name, sum(n) AS total FROM b GROUP BY 1)
SELECT table_name, domain FROM b JOIN t USING (table_name) WHERE domain IS NOT NULL AND n * 100 >= total * 3
"""

P1_DOMAINS = f"""
SELECT table_name, domain, count(*) AS captures, count(DISTINCT url) AS urls, min({_STAMP.format('utc')}) AS first_capture, max({_STAMP.format('utc')}) AS last_capture
FROM {with_utc(_BOTH, 'source')} x GROUP BY 1, 2
"""

P1_SHARED = """
SELECT c.domain, c.status_code, count(*) AS captures, max(r.stored) AS stored FROM cdx_records c JOIN (SELECT domain, count(*) AS stored FROM records GROUP BY 1) r ON r.domain = c.domain GROUP BY 1, 2
"""


_NUMBER = r"[+-]?([0-9]{1,3}(,[0-9]{3})+(\.0*)?|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,4})?)"
_DATES = ["%Y%m%d%H%M%S", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%a, %d %b %Y %H:%M:%S GMT"]

_CELLS = f"""
WITH v AS (SELECT meta_id, record_id, regexp_replace(lower(key), '[^a-z0-9]', '', 'g') AS k, trim(regexp_replace(trim(value, ' ' || chr(9) || chr(10) || chr(13)), '^"(.*)"$', '\\1'), ' ' || chr(9) || chr(10) || chr(13)) AS v FROM metadata WHERE record_id IS NOT NULL),
j AS (SELECT meta_id, record_id, attr, value_type AS t, v FROM v JOIN meta_attributes ON replace(attr, '_', '') = k WHERE lower(v) NOT IN ('', 'n/a', 'null', 'none', 'unknown', '-', '?')),
c AS (SELECT * FROM j WHERE CASE t WHEN 'string' THEN true WHEN 'double' THEN regexp_full_match(v, '{_NUMBER}')
WHEN 'bigint' THEN regexp_full_match(v, '{_NUMBER}') AND try_cast(replace(v, ',', '') AS DOUBLE) = floor(try_cast(replace(v, ',', '') AS DOUBLE))
WHEN 'boolean' THEN lower(v) IN ('true', 'false', 'yes', 'no', 'on', 'off', 't', 'f', 'y', 'n', '1', '0') ELSE {' OR '.join(f"try_strptime(v, '{x}') IS NOT NULL" for x in _DATES)} END)
"""

P4 = f"{_CELLS} SELECT DISTINCT record_id, attr FROM c"
P4_VALUES = f"""{_CELLS}
, b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY record_id, attr ORDER BY meta_id DESC, v DESC) = 1)
SELECT record_id, attr, CASE t WHEN 'bigint' THEN CAST(CAST(replace(v, ',', '') AS DECIMAL(38, 10)) AS BIGINT) END AS whole, CASE t WHEN 'double' THEN CAST(replace(v, ',', '') AS DOUBLE) END AS number,
CASE t WHEN 'boolean' THEN lower(v) IN ('true', 'yes', 'on', 't', 'y', '1') END AS flag,
CASE t WHEN 'string' THEN v WHEN 'timestamp' THEN strftime(coalesce({', '.join(f"try_strptime(v, '{x}')" for x in _DATES)}), '%Y%m%d%H%M%S') END AS text FROM b
"""


def _normal(name: str, row_id: str, source: str) -> str:
    return (
        f"SELECT '{name}' AS table_name, {row_id} AS row_id, {_STAMP.format('utc')} AS utc_time FROM {with_utc(name, source)} x "
        f"WHERE utc IS NOT NULL AND {_STAMP.format('utc')} <> timestamp"
    )


P5 = " UNION ALL ".join(_normal(*x) for x in [("cdx_records", "id", "source"), ("records", "id", "source"), ("archive_hits", "hit_id", "archive")])

_ORPHANS = f"""
SELECT 'metadata' AS table_name, meta_id AS row_id, CAST(record_id AS VARCHAR) AS k, timestamp FROM metadata WHERE record_id IS NOT NULL AND record_id NOT IN (SELECT id FROM records WHERE id IS NOT NULL)
UNION ALL SELECT 'link_graph', id, addr, source_timestamp FROM {addressed('link_graph', 'target_url')} l WHERE addr IS NOT NULL AND addr NOT IN (SELECT addr FROM {addressed('records', 'url')} r WHERE addr IS NOT NULL)
UNION ALL SELECT 'version_chains', version_id, url || ' ' || lower(prev_hash), timestamp FROM version_chains v WHERE url IS NOT NULL AND coalesce(prev_hash, '') <> ''
 AND NOT EXISTS (SELECT 1 FROM version_chains p WHERE p.url = v.url AND lower(p.content_hash) = lower(v.prev_hash))
"""

P7 = f"SELECT table_name, row_id FROM ({_ORPHANS})"
P7_PERIODS = f"""
SELECT table_name, strftime(utc, '%Y%m') AS period, count(*) AS orphans, count(DISTINCT k) AS keys FROM {with_utc('(' + _ORPHANS + ')', None)} x GROUP BY 1, 2
"""

SQL = {
    "p1_found": P1, "p1_domains": P1_DOMAINS, "p1_shared_domains": P1_SHARED, "p2_found": P2, "p4_found": P4, "p4_values": P4_VALUES, "p5_found": P5, "p7_found": P7, "p7_periods": P7_PERIODS,
}
