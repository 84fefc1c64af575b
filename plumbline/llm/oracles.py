"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from plumbline.llm import quality

WORD = r"'[^\x20\x09-\x0D]+'"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def source_mix() -> str:
    return rf"""
WITH d AS (SELECT doc_id, source, 'mix:' || coalesce(CAST(doc_id AS VARCHAR), '') draw, coalesce(len(regexp_extract_all(text, {WORD})), 0) size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) source_size FROM d GROUP BY 1),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE w, 2.0::DOUBLE * source_size lim FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY lim / w, source NULLS LAST) pos FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - (sum(lim) OVER (ORDER BY pos) - lim)) / (sum(w) OVER () - sum(w) OVER (ORDER BY pos) + w) lev FROM o),
m AS (SELECT min_by(lev, pos) lev FROM l WHERE lev <= lim / w),
t AS (SELECT source, source_size, CASE WHEN m.lev IS NULL THEN lim ELSE least(m.lev * w, lim) END target FROM l, m),
u AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END::INT whole FROM t),
v AS (SELECT *, target - whole * source_size rest, CASE WHEN source_size > 0 THEN (target - whole * source_size) / source_size ELSE 0 END rate FROM u),
x AS (SELECT d.*, v.source_size, v.target, whole, rest, (size / (size + 50.0::DOUBLE)) * (rate / (1.0::DOUBLE - rate)) odds, (('0x' || substr(md5(draw), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE q FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source),
y AS (SELECT *, CASE WHEN odds > 0 THEN (q / (1.0::DOUBLE - q)) / odds END ord FROM x),
z AS (SELECT *, CASE WHEN ord IS NOT NULL THEN sum(size) OVER (PARTITION BY source, ord IS NULL ORDER BY ord, draw, size ROWS UNBOUNDED PRECEDING) END up_to FROM y),
g AS (SELECT *, rest - coalesce(max(CASE WHEN up_to <= rest THEN up_to END) OVER (PARTITION BY source), 0) gap FROM z),
h AS (SELECT *, CASE WHEN ord IS NOT NULL AND up_to > rest AND abs(size - gap) < gap THEN row_number() OVER (PARTITION BY source, ord IS NOT NULL AND up_to > rest AND abs(size - gap) < gap ORDER BY abs(size - gap), ord, draw, size) END closing FROM g)
SELECT doc_id, size, source_size, target, whole + CASE WHEN up_to <= rest OR closing = 1 THEN 1 ELSE 0 END copies, CAST(size * (whole + CASE WHEN up_to <= rest OR closing = 1 THEN 1 ELSE 0 END) AS BIGINT) taken FROM h"""


def quality_rules() -> str:
    classes = ", ".join(f"length(regexp_replace(t, '[^{c.replace(chr(39), chr(39) * 2)}]+', '', 'g'))" for c in quality.CLASSES.values())
    words = ", ".join(f"len(list_filter(w, lambda a: a = '{x}'))" for x in quality.COMMON)
    n, m = len(quality.CLASSES) + 1, len(quality.COMMON) + 1
    return rf"""
WITH d AS (SELECT row_number() OVER () r, doc_id, lang, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), {WORD}) w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, {WORD})) ls FROM documents),
p AS (SELECT r, i, w[i + 1] a, w[i + 2] b, w[i + 3] c FROM (SELECT r, w, unnest(range(len(w) - 2)) i FROM d WHERE len(w) >= 3)),
e AS (SELECT r, i FROM p QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
k AS (SELECT r, count(DISTINCT j) n FROM (SELECT r, unnest([i, i + 1, i + 2]) j FROM e) GROUP BY 1),
b AS (SELECT d.*, CAST(len(w) AS BIGINT) n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) n_dup_lines, CAST(coalesce(k.n, 0) AS BIGINT) n_repeat_words FROM d LEFT JOIN k USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed, [{classes}] c0, [{words}] w0 FROM b),
h AS (SELECT *, list_append(c0, word_chars - list_sum(c0)) ch, list_append(w0, n_words - list_sum(w0)) wo FROM f),
v AS (SELECT r, lang, n_words, base_failed, 'c' kind, unnest(range(1, {n + 1})) i, unnest(ch)::DOUBLE x FROM h UNION ALL SELECT r, lang, n_words, base_failed, 'w', unnest(range(1, {m + 1})), unnest(wo)::DOUBLE FROM h),
rl AS (SELECT lang, kind, i, sum(x) y FROM v WHERE NOT base_failed AND lang IS NOT NULL GROUP BY 1, 2, 3),
rp AS (SELECT kind, i, sum(y) y FROM rl GROUP BY 1, 2),
j AS (SELECT v.*, coalesce(rl.y, rp.y) y FROM v LEFT JOIN rl ON v.lang = rl.lang AND v.kind = rl.kind AND v.i = rl.i LEFT JOIN rp ON v.kind = rp.kind AND v.i = rp.i),
q AS (SELECT *, x / nullif(sum(x) OVER (PARTITION BY r, kind), 0) a, y / nullif(sum(y) OVER (PARTITION BY r, kind), 0) b FROM j),
s AS (SELECT r, kind, any_value(n_words) n, sqrt(greatest(0, sum((CASE WHEN a > 0 THEN a * log2(2 * a / (a + b)) ELSE 0 END + CASE WHEN b > 0 THEN b * log2(2 * b / (a + b)) ELSE 0 END) / 2))) js FROM q WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2),
x AS (SELECT r, max(js) js FROM s WHERE n >= CASE WHEN kind = 'c' THEN {quality.CHARACTER_WORDS} ELSE {quality.COMMON_WORDS} END GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(js, 0) < {quality.MOST} kept FROM h LEFT JOIN x USING (r)"""


def line_dedup() -> str:
    blank = r"[\x20\x09-\x0D]"
    return rf"""
WITH d AS (SELECT row_number() OVER () r, doc_id, text, string_split(text, chr(10)) ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) line, unnest(range(len(ls))) i FROM d),
o AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY r ORDER BY i) - length(line) - 1 s, list_filter(string_split(regexp_replace(line, '([.!?])({blank}+)', '\1\2' || chr(1), 'g'), chr(1)), lambda p: p <> '') ps FROM l),
p AS (SELECT *, unnest(ps) piece, unnest(range(len(ps))) k FROM o WHERE len(list_filter(ps, lambda p: regexp_matches(p, {WORD}))) > 1),
u AS (SELECT r, doc_id, i, -1 k, line piece, s FROM o UNION ALL SELECT r, doc_id, i, k, piece, s + sum(length(piece)) OVER (PARTITION BY r, i ORDER BY k) - length(piece) FROM p),
w AS (SELECT *, regexp_extract_all(translate(piece, '{UPPER}', '{LOWER}'), {WORD}) ws, regexp_replace(regexp_replace(piece, '^{blank}+', ''), '{blank}+$', '') t FROM u),
m AS (SELECT *, (len(ws) >= 5 OR length(t) >= 64) AND row_number() OVER (PARTITION BY len(ws) >= 5 OR length(t) >= 64, array_to_string(ws, ' ') ORDER BY doc_id, s) > 1 gone FROM w),
x AS (SELECT r, i, any_value(piece) FILTER (k < 0) line, any_value(s) FILTER (k < 0) s, bool_or(gone) FILTER (k < 0) whole, count(*) FILTER (k >= 0 AND gone) n, string_agg(piece, '' ORDER BY k) FILTER (k >= 0 AND NOT gone) stays, string_agg(s::BIGINT || '-' || (s + length(piece))::BIGINT, ',' ORDER BY k) FILTER (k >= 0 AND gone) parts FROM m GROUP BY 1, 2),
y AS (SELECT *, whole OR (n > 0 AND NOT regexp_matches(coalesce(stays, ''), {WORD})) goes FROM x),
a AS (SELECT r, coalesce(string_agg(CASE WHEN n > 0 THEN stays ELSE line END, chr(10) ORDER BY i) FILTER (NOT goes), '') kept, count(*) n, sum(CASE WHEN goes THEN 1 ELSE n END) g, coalesce(string_agg(CASE WHEN goes THEN s::BIGINT || '-' || (s + length(line))::BIGINT ELSE parts END, ',' ORDER BY i), '') spans FROM y GROUP BY 1)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN kept END AS text, CAST(coalesce(n, 0) AS BIGINT) n_units, CAST(coalesce(g, 0) AS BIGINT) n_removed, coalesce(spans, '') removed_spans FROM d LEFT JOIN a USING (r)"""


_REACHED = "r AS (SELECT a v, a m FROM k UNION SELECT k.b, r.m FROM r JOIN k ON k.a=r.v), c AS (SELECT v, min(m) m FROM r GROUP BY 1)"


def near_vectors() -> str:
    return rf"""
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) x FROM embeddings),
u AS (SELECT vec_id, list_transform(x, lambda v: v / sqrt(list_dot_product(x, x))) x FROM e WHERE len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND list_dot_product(x, x) > 0),
k AS (SELECT p.vec_id a, q.vec_id b FROM u p JOIN u q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x) AND list_dot_product(p.x, q.x) >= 0.9),
{_REACHED}
SELECT vec_id, (SELECT count(*) FROM k WHERE a = vec_id) n_links, coalesce(m, vec_id) component_id, coalesce(m, vec_id) = vec_id kept FROM e LEFT JOIN c ON v = vec_id"""


def jaccard_classes() -> str:
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' ')) END) t FROM d),
n AS (SELECT doc_id, count(*) n FROM g GROUP BY 1),
p AS (SELECT x.doc_id a, y.doc_id b, count(*) shared FROM g x JOIN g y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE shared / (u.n + v.n - shared) >= 0.8),
{_REACHED}
SELECT doc_id, (SELECT count(*) FROM k WHERE a = doc_id) n_links, coalesce(m, doc_id) class_id, coalesce(m, doc_id) = doc_id kept FROM d LEFT JOIN c ON v = doc_id"""


def substring_dedup() -> str:
    return r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h FROM documents),
c AS (SELECT doc_id, h, unnest(range((len(h) // 2 + 462) // 512)) c FROM d WHERE len(h) >= 100),
p AS (SELECT doc_id, c, substr(h, 1024 * c + 1, 1122) p FROM c),
w AS (SELECT doc_id, c, p, unnest(range(least(512, len(p) // 2 - 49))) o FROM p),
k AS (SELECT doc_id, 512 * c + o s, hash(substr(p, 2 * o + 1, 100)) x FROM w),
f AS (SELECT x, min(doc_id) first FROM k GROUP BY 1),
t AS (SELECT k.doc_id, s FROM k JOIN f USING (x) WHERE first < k.doc_id),
i AS (SELECT *, s > lag(s) OVER o + 50 OR lag(s) OVER o IS NULL new FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY s)),
j AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY s) span FROM i),
g AS (SELECT doc_id, min(s) a, max(s) + 50 b FROM j GROUP BY doc_id, span),
q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) z FROM g),
r AS (SELECT doc_id, sum(b - a) n, count(*) spans, max(b) e, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) kept FROM q JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) n_bytes, CAST(coalesce(n, 0) AS BIGINT) n_removed, CAST(coalesce(spans, 0) AS BIGINT) n_spans, sha256(unhex(CASE WHEN r.doc_id IS NULL THEN h ELSE kept || substr(h, 2 * e + 1) END)) kept_sha256 FROM d LEFT JOIN r ON r.doc_id = d.doc_id"""
