"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import url_filter as U

# Words by their place, windows of 35 by a hash, and every word that a window found twice covers.
PHRASES = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + 34), ' ')) AS h
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w)),
twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM win JOIN twice USING (h))),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

# Bytes as pairs of hex digits; a window starts at an odd place.
SUFFIXES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, md5(substring(x, 2 * i - 1, 100)) AS h
        FROM (SELECT doc_id, x, unnest(range(1, CAST(length(x) // 2 - 48 AS BIGINT))) AS i FROM d)),
first AS (SELECT h, min(doc_id) AS least FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (h) WHERE least < doc_id)),
byte AS (SELECT doc_id, p, substring(x, 2 * p - 1, 2) AS b FROM (SELECT doc_id, x, unnest(range(1, CAST(length(x) // 2 + 1 AS BIGINT))) AS p FROM d)),
kept AS (SELECT doc_id, string_agg(b, '' ORDER BY p) AS x FROM byte ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n, count(DISTINCT p - r) AS runs
      FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS r FROM gone) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n.runs, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.x, ''))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

# Lines by their place; keys stripped and in lower case; each key once a document.
LINES = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS p FROM d),
keyed AS (SELECT r, p, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
common AS (SELECT key FROM (SELECT DISTINCT r, key FROM keyed WHERE length(key) >= 1) GROUP BY key HAVING count(*) >= 10),
kept AS (SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY p) AS text FROM keyed ANTI JOIN common USING (key) GROUP BY r)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - coalesce(kept.n, 0) AS BIGINT) AS n_dropped,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

# CRC-32 from its rule, byte by byte; near words by what is left when a code point goes: the same rest at the same
# place is a replaced code point, a rest that is a word an inserted or deleted one.
SPELLING = r"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
           lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
run AS (SELECT doc_id, run, count(*) AS n
        FROM (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
              FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
coded AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM run),
digest AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(x) // 2),
             lambda i: CAST((instr('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 1 AS BIGINT))),
             lambda c, b: xor(c >> 8, t[(xor(c, b) % 256) + 1])), 4294967295) AS h FROM coded, crc),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM digest),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
pair AS (SELECT a.word AS word, b.word AS other, b.n AS n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
         UNION SELECT l.word, w.word, w.n FROM less l JOIN w ON l.rest = w.word
         UNION SELECT w.word, l.word, l.n FROM less l JOIN w ON l.rest = w.word),
near AS (SELECT word, count(*) AS n_near, arg_min(struct_pack(other := other, n := n), struct_pack(less := -n, other := other)) AS best FROM pair GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 5 * w.n THEN best.other END AS form,
             CASE WHEN best.n >= 5 * w.n THEN best.n END AS form_n FROM w LEFT JOIN near USING (word)),
step AS (SELECT word, word AS root, form AS next FROM f
         UNION ALL SELECT s.word, f.word, f.form FROM step s JOIN f ON f.word = s.next)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN step ON step.word = f.word AND step.next IS NULL
"""


def urls(rules: list[tuple[str, str, str]]) -> str:
    """The URL query: rules, counts of grams, the models' orders one by one, scores and the calibrated bound."""
    longest = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in longest]
    name = " ".join(f"WHEN {f} THEN '{n}'" for f, n, _ in fits)
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits)
    upper, lower = U.UPPER, U.LOWER
    finer = "CASE WHEN {t} > 0 THEN (CAST({n} AS DOUBLE) + {k} * {p}) / ({t} + {k}) ELSE {p} END"
    levels = []
    for k in range(1, U.CONTEXT + 2):
        source = (f"(SELECT s.*, CAST({1 / U.ALPHABET!r} AS DOUBLE) AS qg, CAST({1 / U.ALPHABET!r} AS DOUBLE) AS qb FROM seen s WHERE o = 1)" if k == 1 else
                  f"(SELECT s.*, l.pg AS qg, l.pb AS qb FROM seen s JOIN level{k - 1} l ON l.gram = right(s.gram, {k - 1}) WHERE s.o = {k})")
        levels.append(f"level{k} AS MATERIALIZED (SELECT s.gram, whole, {finer.format(t='gn', n='g', k='gt', p='qg')} AS pg, "
                      f"{finer.format(t='bn', n='b', k='bt', p='qb')} AS pb FROM {source} s LEFT JOIN contexts c ON c.before = left(s.gram, {k - 1}))")
    every = " UNION ALL ".join(f"SELECT gram, pg, pb FROM level{k} WHERE whole" for k in range(1, U.CONTEXT + 2))
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
v AS (SELECT page_id, u, instr(u, '://') AS spot, CASE WHEN instr(u, '://') > 0 THEN substr(u, instr(u, '://') + 3) ELSE '' END AS rest FROM u),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
             translate(CASE WHEN spot > 0 THEN rest ELSE u END, '{upper}', '{lower}') AS text FROM v),
r AS (SELECT *, CASE {name} END AS rule, CASE {verdict} END AS ruled FROM p),
kinds AS (SELECT text, count(*) FILTER (WHERE ruled = 'allow') AS allow, count(*) FILTER (WHERE ruled = 'block') AS block,
                 bool_or(ruled IS NULL) AS open, substr(md5(text), 1, 2) < '{U.HELD_OUT}' AS held FROM r GROUP BY text),
each AS (SELECT text, CASE WHEN held THEN 0 ELSE allow END AS good, CASE WHEN held THEN 0 ELSE block END AS bad, held OR open AS wanted,
                substr(s, greatest(1, i - {U.CONTEXT}), least({U.CONTEXT + 1}, i)) AS gram
         FROM (SELECT *, chr(2) || text || chr(3) AS s, unnest(range(2, length(text) + 3)) AS i FROM kinds)),
counts AS (SELECT gram, sum(good) AS good, sum(bad) AS bad FROM each GROUP BY gram),
seen AS MATERIALIZED (SELECT o, right(gram, o) AS gram, CAST(sum(good) AS BIGINT) AS g, CAST(sum(bad) AS BIGINT) AS b, bool_or(length(gram) = o) AS whole
         FROM (SELECT *, CAST(unnest(range(1, length(gram) + 1)) AS INTEGER) AS o FROM counts) GROUP BY ALL),
contexts AS MATERIALIZED (SELECT left(gram, o - 1) AS before, sum(g) AS gn, count(*) FILTER (WHERE g > 0) AS gt, sum(b) AS bn, count(*) FILTER (WHERE b > 0) AS bt
             FROM seen WHERE g + b > 0 GROUP BY ALL),
{", ".join(levels)},
ratios AS (SELECT gram, CAST(round((ln(pg) - ln(pb)) * {U.UNIT}) AS BIGINT) AS ratio FROM ({every})),
scores AS (SELECT text, CAST(trunc(CAST(sum(ratio) AS DOUBLE) / count(*)) AS BIGINT) AS score FROM each JOIN ratios USING (gram) WHERE wanted GROUP BY text),
bins AS (SELECT CAST(greatest(-1000, least(1000, floor(score / CAST({U.BIN} AS DOUBLE)))) AS BIGINT) AS bin, sum(allow) AS good, sum(block) AS bad
         FROM scores JOIN kinds USING (text) WHERE held GROUP BY ALL),
cut AS (SELECT CASE WHEN lag(bin) OVER w IS NULL THEN bin ELSE (lag(bin) OVER w + 1 + bin) / 2.0 END * {U.BIN} AS bound, bin,
               coalesce(sum(bad) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / CAST(sum(bad) OVER () AS DOUBLE)
               - coalesce(sum(good) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / CAST(sum(good) OVER () AS DOUBLE) AS value
        FROM bins WINDOW w AS (ORDER BY bin)),
best AS (SELECT bound FROM cut WHERE isfinite(value) ORDER BY value DESC, bin LIMIT 1)
SELECT page_id, host, path, rule,
       coalesce(ruled, CASE WHEN score < (SELECT bound FROM best) THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN scores USING (text)
"""


SQL = {"op5_suffix_dedup": SUFFIXES, "op10_phrase_dedup": PHRASES, "op12_spelling_variants": SPELLING, "op13_line_dedup": LINES}
