"""The registered queries and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions import scalars
from ..operators import assembly, candidates, contents, filling, hybrid, likeness, manifests, objectives, relations, replies, rows, scoring, segments, tiers, versions
from ..sources import corpora


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(pattern: str, column: str = "text") -> str:
    return f"regexp_matches({column}, {q(pattern)})"


def weights(table) -> str:
    return " + ".join(f"CASE WHEN {rx(p)} THEN {w} ELSE 0 END" for p, w in table)


_ODD = q(corpora.ODD_SPACE.replace("\t", "\\t").replace("\x0b", "\\v").replace("\f", "\\f").replace("\r", "\\r"))
C1 = f"c AS (SELECT doc_id, CAST(generate_subscripts(l, 1) AS INT) AS para, trim(regexp_replace(unnest(l), {_ODD}, ' ', 'g'), ' ') AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"
C3 = "c AS (" + corpora.CONTENTS.replace("{handouts}", corpora.HANDOUTS).replace("{lineitem}", "lineitem").replace("{orders}", "orders") + ")"
C2 = "c AS (" + corpora.HANDOUTS.replace("{lineitem}", "lineitem").replace("{orders}", "orders") + ")"
BOUND = "(" + " OR ".join(rx(p) for p in P.BOUNDARY) + ")"
SECTION = "CASE " + " ".join(f"WHEN {rx(p)} THEN {q(k)}" for p, k in P.SECTION) + " END"
W = "OVER (PARTITION BY doc_id ORDER BY para)"


def number(digits: str) -> str:
    return f"TRY_CAST(translate({digits}, '０１２３４５６７８９', '0123456789') AS INT)"


def after(pattern: str) -> str:
    return f"length(trim(regexp_replace(text, {q(pattern)}, ''), ' '))"


def fold_sql(name: str, pattern: str, condition: str, begin: str) -> str:
    """Paragraphs with a number, walked in order; hit is whether a row goes on from those before."""
    return f"""{name}_r AS (SELECT doc_id, para, {number(f"regexp_extract(text, {q(pattern)}, 1)")} AS num, row_number() {W} AS rn FROM c WHERE {condition}),
{name}_w AS (SELECT doc_id, para, rn, num <= 2 AS hit, CASE WHEN num <= 2 THEN num ELSE 0 END AS last, CASE WHEN num <= 2 THEN 1 ELSE 0 END AS hits FROM {name}_r WHERE rn = 1 AND num <> 1
  UNION ALL SELECT doc_id, para, rn, true, 1, 1 FROM {name}_r WHERE rn = 1 AND num = 1
  UNION ALL SELECT r.doc_id, r.para, r.rn, r.num = w.last + 1 OR (r.num = 1 AND w.last >= 1) OR {begin}, CASE WHEN r.num = w.last + 1 OR (r.num = 1 AND w.last >= 1) OR {begin} THEN r.num ELSE w.last END, w.hits + CASE WHEN r.num = w.last + 1 OR (r.num = 1 AND w.last >= 1) OR {begin} THEN 1 ELSE 0 END
  FROM {name}_w w JOIN {name}_r r ON r.doc_id = w.doc_id AND r.rn = w.rn + 1)"""


def boundary_sql(corpus: str) -> str:
    return f"""WITH RECURSIVE {corpus},
{fold_sql("m", P.MAIN_NUMBER, f"{rx(P.MAIN_NUMBER)} AND {after(P.MAIN_NUMBER)} >= 8", "(r.num <= 2 AND w.hits = 0)")},
{fold_sql("a", P.NUMBER, rx(P.NUMBER), "r.num <= 2")},
s AS (SELECT *, {weights(P.QUESTION)} AS q, {weights(P.KNOWLEDGE)} AS k FROM c),
l AS (SELECT *, lead(q, 1) {W} AS q1, lead(k, 1) {W} AS k1, lead(q, 2) {W} AS q2, lead(k, 2) {W} AS k2 FROM s),
d0 AS (SELECT doc_id, CAST(min(para) AS INT) AS first, CAST(max(para) AS INT) AS last, count(*) AS n, coalesce(min(CASE WHEN {BOUND} AND NOT {rx(P.DOTTED)} THEN para END), min(CASE WHEN q > k AND q >= 2 AND q1 > k1 AND q1 >= 1 AND q2 > k2 AND q2 >= 1 THEN para END)) AS b0, min(CASE WHEN {rx(P.NUMBER)} THEN para END) AS b3 FROM l GROUP BY doc_id),
d1 AS (SELECT d0.*, (SELECT max(para) FROM c WHERE c.doc_id = d0.doc_id AND para < b0 AND {rx(P.NUMBER)} AND {after(P.NUMBER)} >= 6) AS found FROM d0),
d2 AS (SELECT *, CASE WHEN n < 3 THEN NULL WHEN b0 IS NULL THEN b3 WHEN found IS NOT NULL AND b0 - found <= greatest(15, n // 5) AND NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = d1.doc_id AND para > found AND para < b0 AND {rx(P.KNOWLEDGE_HEADING)}) THEN found ELSE b0 END AS boundary FROM d1),
many AS (SELECT doc_id FROM m_w WHERE hit GROUP BY doc_id HAVING count(*) >= 3),
pts AS (SELECT doc_id, para FROM m_w WHERE hit AND doc_id IN (SELECT doc_id FROM many) UNION ALL SELECT doc_id, para FROM a_w WHERE hit AND doc_id NOT IN (SELECT doc_id FROM many)),
lp AS (SELECT p.doc_id, p.para, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.para) - 1 AS i, count(*) OVER (PARTITION BY p.doc_id) AS np FROM pts p JOIN d2 USING (doc_id) WHERE p.para >= boundary),
cu AS (SELECT doc_id, np, greatest(1, CAST(round_even(np * 0.7::DOUBLE, 0) AS INT)) AS cut FROM (SELECT DISTINCT doc_id, np FROM lp)),
cc AS (SELECT d2.*, greatest(boundary, CASE WHEN np >= 2 THEN CASE WHEN cut < np THEN (SELECT para - 1 FROM lp WHERE lp.doc_id = d2.doc_id AND i = cut) ELSE last END ELSE boundary + CAST(floor((last - boundary) * 0.7::DOUBLE) AS INT) END) AS cutp FROM d2 LEFT JOIN cu USING (doc_id) WHERE boundary IS NOT NULL)
"""


BLOCKS = f"""SELECT doc_id, 1 AS ord, {q(P.MARKER_KNOWLEDGE)} AS marker, CAST(CASE WHEN boundary > first THEN first ELSE 1 END AS INT) AS start_para, CAST(CASE WHEN boundary > first THEN boundary - 1 ELSE 0 END AS INT) AS end_para FROM cc
UNION ALL SELECT doc_id, 2, {q(P.MARKER_DRILL)}, CAST(boundary AS INT), CAST(cutp AS INT) FROM cc
UNION ALL SELECT doc_id, 3, {q(P.MARKER_CONSOLIDATION)}, CAST(cutp + 1 AS INT), last FROM cc WHERE cutp < last"""

AUTO = boundary_sql(C2) + f""", fe AS (SELECT *, lead(para, 1) {W} AS p1, lead(text, 1) {W} AS t1, lead(para, 2) {W} AS p2, lead(text, 2) {W} AS t2 FROM c),
sp AS (SELECT doc_id, p1 AS at_p, coalesce({rx(P.ENGLISH)} AND p2 = para + 2 AND {rx(P.ENGLISH, 't2')}, false) AS prose FROM fe WHERE regexp_matches(regexp_replace(text, '/+$', ''), {q(P.SEPARATOR)}) AND p1 = para + 1 AND ({rx(P.SECTION_HEADER, 't1')} OR {rx(P.PART_HEADER, 't1')}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY para) = 1),
tk AS (SELECT doc_id, min(para) AS taken FROM c WHERE {BOUND} OR ({SECTION}) = 'practice' GROUP BY doc_id),
ty AS (SELECT doc_id, {number(f"regexp_extract(text, {q(P.TYPE_MARKER)}, 1)")} AS no, max(para) AS para FROM c WHERE {rx(P.TYPE_MARKER)} GROUP BY ALL),
tl AS (SELECT doc_id, list(para ORDER BY no) AS types FROM ty GROUP BY doc_id),
bl AS (SELECT doc_id, list(para ORDER BY para) FILTER (text = '') AS blanks, list(para ORDER BY para) FILTER ({rx(P.SECTION_HEADER)}) AS headers FROM c GROUP BY doc_id),
pl AS (SELECT doc_id, list(para ORDER BY para) AS points FROM pts GROUP BY doc_id),
x0 AS (SELECT d2.doc_id, first, last, n, boundary, types, blanks, headers, coalesce(points, []) AS points, CASE WHEN types IS NOT NULL THEN 'type' WHEN at_p IS NOT NULL AND NOT coalesce(taken < at_p, false) AND NOT (prose AND at_p + 1 < last) THEN 'separator' WHEN boundary IS NOT NULL THEN 'score' ELSE 'proportional' END AS tier, at_p FROM d2 LEFT JOIN sp USING (doc_id) LEFT JOIN tk USING (doc_id) LEFT JOIN tl USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN pl USING (doc_id)),
x1 AS (SELECT *, CASE tier WHEN 'type' THEN types[1] WHEN 'separator' THEN at_p WHEN 'score' THEN boundary END AS b, CASE tier WHEN 'type' THEN types ELSE list_filter(points, lambda p: p >= CASE tier WHEN 'separator' THEN at_p ELSE boundary END) END AS pt,
  first + CAST(trunc((last - first) * 0.5::DOUBLE) AS INT) AS g1, first + CAST(trunc((last - first) * 0.85::DOUBLE) AS INT) AS g2 FROM x0),
x2 AS (SELECT *, greatest(1, CAST(round_even(len(pt) * 0.7::DOUBLE, 0) AS INT)) AS cut, {", ".join(f"coalesce(list_sort(list_filter(list_transform(blanks, lambda p: [abs(p - {g}), p]), lambda e: e[1] <= greatest(3, n // 20)))[1][2], list_sort(list_filter(list_transform(headers, lambda p: [abs(p - {g}), p]), lambda e: e[1] <= greatest(5, n // 10)))[1][2], {g}) AS s{g[1]}" for g in ("g1", "g2"))} FROM x1),
x3 AS (SELECT *, greatest(first, least(s1, last)) AS p1, greatest(greatest(first, least(s1, last)) + 1, least(s2, last)) AS p2, CASE WHEN len(pt) >= 2 THEN CASE WHEN cut < len(pt) THEN pt[cut + 1] - 1 ELSE last END ELSE b + CAST(trunc((last - b) * 0.7::DOUBLE) AS INT) END AS e0 FROM x2),
x4 AS (SELECT doc_id, tier, first, last, CASE tier WHEN 'proportional' THEN p1 ELSE b END AS b, CASE tier WHEN 'proportional' THEN p2 - 1 WHEN 'type' THEN e0 ELSE greatest(b, e0) END AS e, CASE tier WHEN 'proportional' THEN first WHEN 'type' THEN first ELSE b END AS since FROM x3),
ev AS (SELECT doc_id, para, {rx(P.READING)} AS begins FROM c WHERE {rx(P.READING)} OR {rx(P.READING_ENDS)}),
rs AS (SELECT doc_id, para AS rs, begins, lead(para) {W} - 1 AS re FROM ev),
x5 AS (SELECT x4.*, (SELECT arg_min(coalesce(re, last), rs) FROM rs WHERE rs.doc_id = x4.doc_id AND begins AND rs >= since AND rs <= e AND e < coalesce(re, last)) AS moved FROM x4),
x6 AS (SELECT *, tier IN ('type', 'proportional') OR e < last AS third FROM x5)
SELECT doc_id, tier, 1 AS ord, {q(P.MARKER_KNOWLEDGE)} AS marker, CAST(CASE WHEN tier = 'proportional' THEN first WHEN b > first THEN first ELSE 1 END AS INT) AS start_para, CAST(CASE WHEN tier = 'proportional' THEN greatest(first, b - 1) WHEN b > first THEN b - 1 ELSE 0 END AS INT) AS end_para FROM x6
UNION ALL SELECT doc_id, tier, 2, {q(P.MARKER_DRILL)}, CAST(b AS INT), CAST(CASE WHEN third THEN coalesce(moved, e) ELSE e END AS INT) FROM x6
UNION ALL SELECT doc_id, tier, 3, {q(P.MARKER_CONSOLIDATION)}, CAST(coalesce(moved, e) + 1 AS INT), last FROM x6 WHERE third"""

IMAGES = boundary_sql(C2) + f""", bb AS ({BLOCKS}), pi AS (SELECT doc_id, list(para) AS pics FROM c WHERE has_img AND {rx(P.DECOR)} GROUP BY doc_id),
b1 AS (SELECT doc_id, max(start_para) FILTER (ord = 1) AS s1, max(end_para) FILTER (ord = 1) AS e1, max(start_para) FILTER (ord = 2) AS s2, max(end_para) FILTER (ord = 2) AS e2, max(start_para) FILTER (ord = 3) AS s3, max(end_para) FILTER (ord = 3) AS e3 FROM bb GROUP BY doc_id),
i1 AS (SELECT b1.*, coalesce(pics, []) AS pics FROM b1 LEFT JOIN pi USING (doc_id)),
i2 AS (SELECT *, {{back('s2', 's1')}} AS k2 FROM i1), i3 AS (SELECT *, {{back('s3', '(s2 - k2)')}} AS k3 FROM i2)
SELECT doc_id, 1 AS ord, {q(P.MARKER_KNOWLEDGE)} AS marker, s1 AS start_para, CAST(CASE WHEN k2 > 0 THEN s2 - k2 - 1 ELSE e1 END AS INT) AS end_para FROM i3
UNION ALL SELECT doc_id, 2, {q(P.MARKER_DRILL)}, CAST(s2 - k2 AS INT), CAST(CASE WHEN s3 IS NOT NULL AND k3 > 0 THEN s3 - k3 - 1 ELSE e2 END AS INT) FROM i3
UNION ALL SELECT doc_id, 3, {q(P.MARKER_CONSOLIDATION)}, CAST(s3 - k3 AS INT), e3 FROM i3 WHERE s3 IS NOT NULL"""
for _s, _lo in (("s2", "s1"), ("s3", "(s2 - k2)")):
    _at = [f"list_contains(pics, {_s} - {k}) AND {_s} - {k} >= {_lo}" for k in (1, 2, 3)]
    IMAGES = IMAGES.replace("{back('" + _s + "', '" + _lo + "')}", f"CASE WHEN {_at[0]} AND {_at[1]} AND {_at[2]} THEN 3 WHEN {_at[0]} AND {_at[1]} THEN 2 WHEN {_at[0]} THEN 1 ELSE 0 END")


def short_sql(column: str, limit: int = 80) -> str:
    t = f"trim(regexp_replace({column}, '\\s+', ' ', 'g'), ' ')"
    return f"CASE WHEN length({t}) > {limit} THEN concat(substring({t}, 1, {limit - 1}), '…') ELSE {t} END"


def words_sql(words: list[str], strong: list[str], kind: str, scores: tuple[int, int], seq: int) -> str:
    word = "CASE " + " ".join(f"WHEN contains(text, {q(w)}) THEN {q(w)}" for w in words) + " END"
    listed = ", ".join(q(w) for w in strong)
    return f"SELECT doc_id, '{kind}' AS kind, para, CASE WHEN word IN ({listed}) THEN {scores[0]} ELSE {scores[1]} END AS score, concat({q(candidates.PRACTICE_WORD if kind == candidates.PRACTICE else candidates.CONSOLIDATION_WORD)}, word) AS reason, {short_sql("text")} AS text, 'marker' AS source, {seq} AS seq FROM (SELECT *, {word} AS word FROM ok) WHERE word IS NOT NULL"


CANDIDATES = f"""WITH RECURSIVE {C2}, {fold_sql("n", P.NUMBER + r"\s*\S", rx(P.NUMBER + r"\s*\S"), "r.num <= 2")},
e0 AS (SELECT doc_id, CAST(min(para) AS INT) AS first, CAST(max(para) AS INT) AS last FROM c GROUP BY doc_id),
se AS (SELECT *, regexp_extract(text, {q(P.COURSE_SECTION)}, 1) AS sec FROM c),
ok AS (SELECT * FROM se WHERE text <> '' AND NOT {rx(P.DOTTED)} AND NOT (sec = '04' AND EXISTS (SELECT 1 FROM se y WHERE y.doc_id = se.doc_id AND y.sec = '05' AND y.para - se.para BETWEEN 1 AND 2)) AND NOT (sec = '05' AND EXISTS (SELECT 1 FROM se y WHERE y.doc_id = se.doc_id AND y.sec = '04' AND se.para - y.para BETWEEN 1 AND 2))),
hit AS (SELECT doc_id, para, lead(para, 2) {W} AS third FROM n_w WHERE hit),
de AS (SELECT doc_id, min(para) AS para FROM hit WHERE third - para <= 18 GROUP BY doc_id),
ds AS (SELECT de.doc_id, de.para, {rx(P.YEAR_TAG)} OR {rx(P.BLANK)} OR EXISTS (SELECT 1 FROM c y WHERE y.doc_id = c.doc_id AND y.para > c.para AND y.para <= c.para + 5 AND {rx(P.OPTION, 'y.text')}) AS strong, (de.para - first) / greatest(last - first, 1)::DOUBLE >= 0.25 AS late, {short_sql("text")} AS head FROM de JOIN c USING (doc_id, para) JOIN e0 USING (doc_id)),
ca AS (SELECT doc_id, 'practice_start' AS kind, para, 96 AS score, {q(candidates.SECTION_04)} AS reason, {short_sql("text")} AS text, 'toc' AS source, 1 AS seq FROM ok WHERE sec = '04'
  UNION ALL SELECT doc_id, 'consolidation_start', para, 98, {q(candidates.SECTION_05)}, {short_sql("text")}, 'toc', 2 FROM ok WHERE sec = '05'
  UNION ALL {words_sql(P.PRACTICE_WORDS, P.STRONG_PRACTICE_WORDS, candidates.PRACTICE, (97, 90), 3)}
  UNION ALL {words_sql(P.CONSOLIDATION_WORDS, P.STRONG_CONSOLIDATION_WORDS, candidates.CONSOLIDATION, (98, 91), 4)}
  UNION ALL SELECT doc_id, 'practice_start', para, 88, {q(candidates.READING)}, {short_sql("text")}, 'reading', 5 FROM ok WHERE {rx(P.READING_START)}
  UNION ALL SELECT doc_id, 'practice_start', para, CASE WHEN strong THEN 86 WHEN late THEN 74 ELSE 62 END, CASE WHEN strong THEN {q(candidates.DENSE_STRONG)} WHEN late THEN {q(candidates.DENSE_LATE)} ELSE {q(candidates.DENSE_EARLY)} END, head, 'question_density', 6 FROM ds),
me AS (SELECT doc_id, kind, para, max(score) AS score, arg_max(text, score * 10 - seq) AS text, arg_max(source, score * 10 - seq) AS source, string_agg(reason, '；' ORDER BY seq) AS reason FROM ca GROUP BY doc_id, kind, para),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY score DESC, para) AS place FROM me),
ch0 AS (SELECT e0.*, p.para AS p_para, p.score AS p_score, p.source AS p_source, (SELECT arg_min({{'para': k.para, 'score': k.score, 'source': k.source}}, place) FROM rk k WHERE k.doc_id = e0.doc_id AND k.kind = 'consolidation_start' AND k.para > p.para) AS later, coalesce((SELECT list(h.para ORDER BY h.para) FROM hit h WHERE h.doc_id = e0.doc_id AND h.para >= p.para), []) AS hits FROM e0 LEFT JOIN rk p ON p.doc_id = e0.doc_id AND p.kind = 'practice_start' AND p.place = 1),
ch1 AS (SELECT *, greatest(1, CAST(round_even(len(hits) * 0.7::DOUBLE, 0) AS INT)) AS cut FROM ch0),
ch AS (SELECT *, CASE WHEN later IS NOT NULL THEN later WHEN p_para IS NULL THEN NULL WHEN len(hits) >= 4 AND cut < len(hits) THEN {{'para': hits[cut + 1], 'score': 55, 'source': 'fallback'}} ELSE {{'para': greatest(p_para + 1, least(p_para + CAST(trunc((last - p_para) * 0.7::DOUBLE) AS INT), last)), 'score': 45, 'source': 'fallback'}} END AS c FROM ch1)
"""


def close_sql(kind: str) -> str:
    return f"coalesce((SELECT a.score - b.score <= 5 AND abs(a.para - b.para) >= 20 FROM rk a JOIN rk b ON a.doc_id = b.doc_id AND a.kind = b.kind WHERE a.doc_id = ch.doc_id AND a.kind = '{kind}' AND a.place = 1 AND b.place = 2), false)"


GROUPS = f"""WITH {C2}, s AS (SELECT *, sum(CASE WHEN {rx(P.TYPE_ROW)} THEN 1 ELSE 0 END) {W} AS section, count(*) OVER (PARTITION BY doc_id) AS total, max(para) OVER (PARTITION BY doc_id) AS last FROM c),
g AS (SELECT doc_id, section, any_value(total) AS total, any_value(last) AS last, max(para) AS section_end, list(para ORDER BY para) FILTER ({rx(P.EXAM_QUESTION)}) AS asked FROM s WHERE section > 0 GROUP BY doc_id, section),
r AS (SELECT doc_id, total, asked[1] AS start_para, CAST(CASE WHEN len(asked) > 1 THEN asked[2] - 1 WHEN section_end = last THEN last END AS INT) AS end_para FROM g WHERE asked IS NOT NULL)
SELECT doc_id, start_para, end_para, sum(end_para - start_para + 1) OVER (PARTITION BY doc_id) <= total * 0.4 AS sound FROM r WHERE end_para IS NOT NULL"""

IDEAL = f"""WITH {C2}, s AS (SELECT *, min(CASE WHEN {rx(P.TYPE_ROW)} THEN para END) OVER (PARTITION BY doc_id) AS since FROM c),
d AS (SELECT doc_id, CAST(min(para) AS INT) AS first, CAST(max(para) AS INT) AS last, any_value(since) AS since, min(CASE WHEN {rx(P.SECTOR)} AND para >= since THEN para END) AS sector, list(para ORDER BY para) FILTER ({rx(P.EXAM_QUESTION)}) AS asked FROM s WHERE since IS NOT NULL GROUP BY doc_id),
e AS (SELECT *, coalesce(sector, asked[11]) AS third FROM d WHERE len(asked) >= 2)
SELECT doc_id, 1 AS ord, {q(P.MARKER_KNOWLEDGE)} AS marker, first AS start_para, CAST(since - 1 AS INT) AS end_para FROM e
UNION ALL SELECT doc_id, 2, {q(P.MARKER_DRILL)}, since, CAST(coalesce(third - 1, last) AS INT) FROM e
UNION ALL SELECT doc_id, 3, {q(P.MARKER_CONSOLIDATION)}, third, last FROM e WHERE third IS NOT NULL"""

ANSWERS = f"a AS (SELECT *, max(CASE WHEN {rx(P.ANSWER)} THEN para END) {W} AS marker, max(CASE WHEN {rx(P.ANSWER_ENDS)} THEN para END) {W} AS head FROM c), g AS (SELECT *, marker IS NOT NULL AND coalesce(head, 0) <= marker AS gone FROM a)"
SPANS = f"h AS (SELECT *, max(CASE WHEN {rx(P.QUESTION_HEADER)} THEN para END) {W} AS head FROM c), k AS (SELECT doc_id, head, max(para) AS end_para, CASE WHEN bool_or({rx(P.CHOICE_LINE)}) THEN 'choice' WHEN bool_or({rx(P.BLANK_SPACE)}) THEN 'blank' ELSE 'short' END AS kind FROM h WHERE head IS NOT NULL GROUP BY doc_id, head)"


def student_sql(corpus: str) -> str:
    """The rows of a student's version with its answer space."""
    return f"WITH c0 AS (WITH {corpus}, {ANSWERS}, n AS (SELECT *, lead(text) {W} AS nxt, row_number() {W} AS rn FROM g WHERE NOT gone) SELECT doc_id, CAST(row_number() {W} AS INT) AS para, text FROM n WHERE rn = 1 OR NOT (text = '' AND coalesce(nxt = '', false))), c AS (SELECT * FROM c0), {SPANS}, u AS (SELECT doc_id, para, 0 AS extra, text FROM c UNION ALL SELECT doc_id, end_para, unnest([1, 2, 3]), '' FROM k WHERE kind = 'short') SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY para, extra) AS INT) AS para, text FROM u"


def refine_sql(blocks: str) -> str:
    """CTEs that end in ``cut``: for documents of ``blocks`` the boundary of their practice, if it is inside."""
    practice = f"marker IN ({q(P.MARKER_DRILL)}, {q(P.MARKER_CONSOLIDATION)}) AND start_para <= end_para"
    return f"""pp AS (SELECT * FROM (VALUES {", ".join(f"({k}, {q(b)}, {q(a)})" for k, (b, a) in enumerate(P.PRACTICE_PAIRS))}) v(pair, basic, advanced)),
pz AS (SELECT doc_id, arg_min(start_para, ord) AS s0, max(end_para) AS e0 FROM {blocks} WHERE {practice} GROUP BY doc_id),
pc AS (SELECT c.doc_id, c.para, text, s0, e0 FROM c JOIN pz USING (doc_id) WHERE para >= s0 AND para > {rows.CONTENTS_END} AND para <= e0),
pa AS (SELECT doc_id, pair, min(para) AS since FROM pc JOIN pp ON contains(text, basic) GROUP BY doc_id, pair),
px AS (SELECT pc.doc_id, pa.pair, min(pc.para) AS para FROM pc JOIN pa ON pa.doc_id = pc.doc_id AND pc.para >= pa.since JOIN pp ON pp.pair = pa.pair AND contains(pc.text, pp.advanced) GROUP BY pc.doc_id, pa.pair
  UNION ALL SELECT pc.doc_id, {len(P.PRACTICE_PAIRS)}, min(pc.para) FROM pc JOIN pp ON contains(pc.text, pp.advanced) GROUP BY pc.doc_id),
pb AS (SELECT doc_id, arg_min(para, pair) AS para FROM px GROUP BY doc_id),
cut AS (SELECT doc_id, pb.para AS cut FROM pb JOIN pz USING (doc_id) WHERE s0 < pb.para AND pb.para < e0)"""


def refined_sql(blocks: str, extra: str) -> str:
    later = f"marker IN ({q(P.MARKER_CONSOLIDATION)}, {q(P.CLASS_CONSOLIDATION)})"
    return f"SELECT doc_id, {extra} ord, marker, CAST(CASE WHEN {later} AND start_para <= end_para AND cut > start_para THEN cut ELSE start_para END AS INT) AS start_para, CAST(CASE WHEN marker = {q(P.MARKER_DRILL)} AND start_para <= end_para AND cut IS NOT NULL THEN cut - 1 ELSE end_para END AS INT) AS end_para FROM {blocks} LEFT JOIN cut USING (doc_id)"


def said_sql(kind: str) -> str:
    """The class (0) or confidence (1) of paragraphs that say what they are."""
    k = 0 if kind == "category" else 1
    title = f"length(text) < 30 AND NOT {rx(P.NUMBERED_QUESTION)}"
    tests = [
        (rx(P.TYPE_MARKER), ("practice", 100)), (rx(P.EXAMPLE), ("example", 100)), (rx(P.SUMMARY), ("knowledge", 95)), (f"{rx(P.ANSWER_HEADER)} OR {rx(P.PRACTICE_HEADER)}", ("practice", 95)),
        (f"{rx(P.KNOWLEDGE_HEADER)} AND {rx(P.CONCEPT)}", ("knowledge", 95)), (f"{rx(P.KNOWLEDGE_HEADER)} AND {title}", ("knowledge", 90)), (rx(P.OPTION), ("practice", 90)), (f"{rx(P.BLANK)} OR {rx(P.FILL_IN)}", ("practice", 85)), (f"{rx(P.SEPARATOR)} OR text = ''", ("other", 100)),
    ]
    return "CASE " + " ".join(f"WHEN {t} THEN {q(v[k]) if k == 0 else v[k]}" for t, v in tests) + " END"


HYBRID = f"""WITH RECURSIVE {C2},
r AS (SELECT doc_id, para, text, row_number() {W} AS rn, percent_rank() {W} AS ratio, {said_sql("category")} AS said, {said_sql("confidence")} AS sure, {rx(P.NUMBERED_QUESTION)} AS asks, len(regexp_extract_all(text, {q(P.CONCEPT)})) AS concepts FROM c),
r1 AS (SELECT *, 50 + CASE WHEN {rx(P.STRUCTURE_HEADER)} THEN 30 ELSE 0 END + CASE WHEN asks THEN 30 ELSE 0 END + CASE WHEN concepts >= 2 THEN 25 WHEN concepts = 1 THEN 15 ELSE 0 END - CASE WHEN {rx(P.EXAM_YEAR)} THEN 20 ELSE 0 END + CASE WHEN length(text) > 200 THEN 10 WHEN length(text) < 20 THEN -10 ELSE 0 END + CASE WHEN ratio < 0.3 THEN 5 WHEN ratio > 0.7 THEN -10 ELSE 0 END AS points,
  CASE WHEN asks THEN 'practice' WHEN concepts > 0 THEN 'knowledge' WHEN {rx(P.OPTION)} OR {rx(P.BLANK)} THEN 'practice' WHEN length(text) > 150 THEN 'knowledge' WHEN length(text) < 20 THEN 'practice' ELSE 'knowledge' END AS guess,
  CASE WHEN asks THEN 0.8 WHEN concepts > 0 THEN 0.7 WHEN {rx(P.OPTION)} OR {rx(P.BLANK)} THEN 0.85 WHEN length(text) > 150 THEN 0.6 WHEN length(text) < 20 THEN 0.55 ELSE 0.5 END::DOUBLE AS likeness FROM r),
w AS (SELECT doc_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS INT) AS para, '' AS before, '' AS category, CAST(0 AS DOUBLE) AS confidence FROM (SELECT DISTINCT doc_id FROM c)
  UNION ALL SELECT doc_id, rn, para, CASE WHEN known THEN class ELSE before END, CASE WHEN known THEN class ELSE guess END, CASE WHEN known THEN n / 100::DOUBLE ELSE likeness END FROM (SELECT *, class <> 'other' AND n >= {hybrid.SURE} AS known FROM (
    SELECT *, CASE WHEN said IS NOT NULL THEN said WHEN m >= 80 THEN 'knowledge' WHEN asks THEN 'practice' WHEN m >= 60 THEN 'knowledge' ELSE 'other' END AS class, coalesce(sure, m) AS n FROM (
      SELECT r1.doc_id, r1.rn, r1.para, w.before, r1.said, r1.sure, r1.asks, r1.guess, r1.likeness, greatest(0, least(100, points + CASE w.before WHEN 'knowledge' THEN 10 WHEN 'practice' THEN -10 ELSE 0 END)) AS m FROM w JOIN r1 ON r1.doc_id = w.doc_id AND r1.rn = w.rn + 1)))),
y AS (SELECT doc_id, para, category, confidence FROM w WHERE rn > 0)"""

READING_SQL = f"""ev AS (SELECT doc_id, para, {rx(P.READING)} AS begins FROM c WHERE {rx(P.READING)} OR {rx(P.READING_ENDS)}),
rs AS (SELECT doc_id, para AS rs, begins, lead(para) {W} - 1 AS re FROM ev)"""


def protected_sql(blocks: str) -> str:
    """Blocks (doc_id, ord, marker, start_para, end_para, last) of which drill ends inside no reading passage, if another block follows."""
    return f"""mv AS (SELECT b.doc_id, arg_min(coalesce(re, last), rs) AS moved FROM {blocks} b JOIN rs ON rs.doc_id = b.doc_id AND begins AND rs <= end_para AND end_para < coalesce(re, last) WHERE ord = 2 AND b.doc_id IN (SELECT doc_id FROM {blocks} WHERE ord = 3) GROUP BY b.doc_id),
pr AS (SELECT doc_id, ord, marker, CAST(CASE WHEN ord = 3 AND moved IS NOT NULL THEN moved + 1 ELSE start_para END AS INT) AS start_para, CAST(CASE WHEN ord = 2 AND moved IS NOT NULL THEN moved ELSE end_para END AS INT) AS end_para FROM {blocks} LEFT JOIN mv USING (doc_id))"""


HYBRID_BLOCKS = f"""{HYBRID}, {READING_SQL},
e0 AS (SELECT doc_id, CAST(min(para) AS INT) AS first, CAST(max(para) AS INT) AS last FROM c GROUP BY doc_id),
e1 AS (SELECT e0.*, coalesce(k, first + CAST(trunc((last - first) * 0.3::DOUBLE) AS INT)) AS k_end, coalesce(asked, []) AS asked FROM e0 LEFT JOIN (SELECT doc_id, max(para) FILTER (category IN ('knowledge', 'example')) AS k, list(para ORDER BY para) FILTER (category = 'practice') AS asked FROM y GROUP BY doc_id) USING (doc_id)),
e2 AS (SELECT *, list_filter(asked, lambda p: p > k_end) AS a, greatest(coalesce(asked[1], k_end + 1), k_end + 1) AS ps, coalesce(asked[-1], last) AS pe FROM e1),
e3 AS (SELECT *, least(ps, last) AS p_start, CASE WHEN ps > last OR pe < ps THEN last ELSE pe END AS p_end, greatest(1, CAST(round_even(len(a) * 0.7::DOUBLE, 0) AS INT)) AS n, last - k_end - 1 AS span FROM e2),
e4 AS (SELECT doc_id, first, last, k_end, CASE WHEN len(a) >= 3 THEN coalesce(a[n + 1] - 1, p_end) WHEN span <= 0 THEN last ELSE least(k_end + 1 + CAST(trunc(span * 0.7::DOUBLE) AS INT), last) END AS t, CASE WHEN len(a) >= 3 THEN p_start WHEN span <= 0 THEN last + 1 ELSE k_end + 1 END AS s, CASE WHEN len(a) >= 3 THEN p_end ELSE last END AS e FROM e3),
e5 AS (SELECT *, least(t, e, last) AS u FROM e4),
mb AS (SELECT doc_id, 1 AS ord, {q(P.MARKER_KNOWLEDGE)} AS marker, first AS start_para, k_end AS end_para, last FROM e5
  UNION ALL SELECT doc_id, 2, {q(P.MARKER_DRILL)}, CASE WHEN u >= s AND s <= last THEN s ELSE 1 END, CASE WHEN u >= s AND s <= last THEN u ELSE 0 END, last FROM e5
  UNION ALL SELECT doc_id, 3, {q(P.MARKER_CONSOLIDATION)}, least(u + 1, last), last, last FROM e5),
{protected_sql("mb")} SELECT * FROM pr"""


def name_sql(column: str) -> str:
    t = f"trim({column}, ' ')"
    line = f"regexp_extract({t}, '^(.+?)\\s*\\.{{5,}}\\s*\\p{{Nd}}*\\s*$', 1)"
    return f"CASE WHEN {line} <> '' THEN trim({line}, ' ') ELSE trim(regexp_replace({t}, '\\.{{3,}}\\s*\\p{{Nd}}*$', ''), ' ') END"


def role_sql(column: str) -> str:
    section = number(f"regexp_extract({column}, {q(P.TOC_SECTION)}, 1)")
    words = [(P.TOC_ADVANCED, "advanced_practice"), (P.TOC_BASIC, "basic_practice"), (P.TOC_PRACTICE, "practice"), (P.TOC_KNOWLEDGE, "knowledge")]
    return "CASE " + " ".join(f"WHEN {rx('|'.join(w), column)} THEN '{k}'" for w, k in words) + f" WHEN {section} <= 3 THEN 'knowledge' WHEN {section} = 4 THEN 'basic_practice' WHEN {section} > 4 THEN 'advanced_practice' WHEN {rx(P.TOC_NUMBERED, column)} THEN 'practice' END"


ENTRIES_SQL = f"""n0 AS (SELECT doc_id, para, text, {rx(P.DOTTED)} AS dots, {name_sql("text")} AS name FROM c WHERE para <= {contents.SCANNED}), n1 AS (SELECT *, {role_sql("name")} AS role FROM n0),
n2 AS (SELECT *, CASE WHEN text = '' THEN 'empty' WHEN text IN ({", ".join(map(q, P.TOC_TITLES))}) THEN 'title' WHEN role IS NOT NULL AND CASE WHEN dots THEN length(name) >= 2 ELSE length(text) < 60 END THEN 'entry' WHEN NOT dots AND length(text) < 60 THEN 'other' END AS kind FROM n1),
n3 AS (SELECT doc_id, min(para) AS title FROM n2 WHERE kind = 'title' GROUP BY doc_id),
n4 AS (SELECT n2.doc_id, para, role, name, CASE kind WHEN 'title' THEN 'other' ELSE kind END AS kind FROM n2 JOIN n3 USING (doc_id) WHERE para > title),
n5 AS (SELECT n3.doc_id, min(para) FILTER (kind = 'entry') AS since, min(para) FILTER (kind = 'empty') AS blank FROM n3 LEFT JOIN n4 USING (doc_id) GROUP BY n3.doc_id),
n6 AS (SELECT n5.doc_id, least(blank, (SELECT min(para) FROM n4 WHERE n4.doc_id = n5.doc_id AND kind = 'other' AND para > since)) AS stop FROM n5),
n7 AS (SELECT n4.doc_id, para, role, name FROM n4 JOIN n6 USING (doc_id) WHERE kind = 'entry' AND (stop IS NULL OR para < stop)),
ent AS (SELECT n6.doc_id, CAST(coalesce(stop, coalesce((SELECT max(para) FROM n7 WHERE n7.doc_id = n6.doc_id), {contents.SCANNED}) + 1) AS INT) AS toc_end FROM n6)"""
_BARE = reduce(lambda c, p: f"regexp_replace({c}, {q(p)}, '', 'g')", (P.NAV_DECOR, P.NAV_BRACKETS, P.NAV_ORDINAL), "text")
HEADINGS_SQL = f"""v0 AS (SELECT doc_id, para, text, {_BARE} AS bare FROM c),
v1 AS (SELECT doc_id, para, text, trim(regexp_replace(CASE WHEN bare <> '' THEN bare ELSE text END, {q(P.PARENTHESES)}, '', 'g'), ' ') AS name FROM v0 WHERE {rx(P.NAV_HEADER)} OR {rx(P.NAV_HEADER, 'bare')}),
v2 AS (SELECT doc_id, para, coalesce({role_sql("text")}, {role_sql("name")}) AS role, name FROM v1 WHERE length(name) >= 3 QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY para) = 1)"""


def contents_sql(corpus: str) -> str:
    bare = "text"
    for pattern in (P.NAV_DECOR, P.NAV_BRACKETS, P.NAV_ORDINAL):
        bare = f"regexp_replace({bare}, {q(pattern)}, '', 'g')"
    letters = lambda c: f"regexp_replace({c}, {q(P.NO_WORD)}, '', 'g')"
    return f"""WITH RECURSIVE {corpus}, {READING_SQL},
{ENTRIES_SQL},
big AS (SELECT doc_id FROM n7 GROUP BY doc_id HAVING count(*) >= 2),
v0 AS (SELECT doc_id, para, text, {bare} AS bare FROM c WHERE doc_id NOT IN (SELECT doc_id FROM big)),
v1 AS (SELECT doc_id, para, text, trim(regexp_replace(CASE WHEN bare <> '' THEN bare ELSE text END, {q(P.PARENTHESES)}, '', 'g'), ' ') AS name FROM v0 WHERE {rx(P.NAV_HEADER)} OR {rx(P.NAV_HEADER, 'bare')}),
v2 AS (SELECT doc_id, para, coalesce({role_sql("text")}, {role_sql("name")}) AS role FROM v1 WHERE length(name) >= 3 QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY para) = 1),
f0 AS (SELECT n7.doc_id, toc_end, n7.role, name, row_number() OVER (PARTITION BY n7.doc_id ORDER BY n7.para) AS nth FROM n7 JOIN big USING (doc_id) JOIN ent USING (doc_id) WHERE n7.role <> 'knowledge' AND length(name) >= 2),
f1 AS (SELECT f0.*, c.para, CASE WHEN text = name THEN 1 WHEN starts_with(text, name) THEN 2 WHEN contains(text, name) THEN 3 WHEN length({letters("name")}) >= 3 AND contains({letters("text")}, {letters("name")}) THEN 4 END AS level FROM f0 JOIN c ON c.doc_id = f0.doc_id AND c.para >= toc_end),
f2 AS (SELECT doc_id, any_value(toc_end) AS toc_end, any_value(role) AS role, list({{'l': level, 'p': para}} ORDER BY level, para) AS at, row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS rn FROM f1 WHERE level IS NOT NULL GROUP BY doc_id, nth),
f3 AS (SELECT doc_id, CAST(0 AS BIGINT) AS rn, toc_end AS since, CAST(NULL AS INT) AS para, '' AS role FROM (SELECT DISTINCT doc_id, toc_end FROM f2)
  UNION ALL SELECT doc_id, rn, coalesce(para + 1, since), para, role FROM (SELECT f2.doc_id, f2.rn, f3.since, f2.role, list_filter(f2.at, lambda x: x.p >= f3.since AND x.p <= f3.since + {contents.REACH})[1].p AS para FROM f3 JOIN f2 ON f2.doc_id = f3.doc_id AND f2.rn = f3.rn + 1)),
pl AS (SELECT doc_id, para, role FROM f3 WHERE para IS NOT NULL UNION ALL SELECT doc_id, para, role FROM v2 WHERE role <> 'knowledge'),
z0 AS (SELECT doc_id, min(para) AS lead_para, arg_min(role, para) AS lead_role, min(para) FILTER (role = 'basic_practice') AS basic FROM pl GROUP BY doc_id),
z1 AS (SELECT z0.*, (SELECT min(para) FROM pl WHERE pl.doc_id = z0.doc_id AND role = 'advanced_practice' AND para > basic) AS advanced, first, last FROM z0 JOIN (SELECT doc_id, CAST(min(para) AS INT) AS first, CAST(max(para) AS INT) AS last FROM c GROUP BY doc_id) USING (doc_id)),
mb AS (SELECT doc_id, 1 AS ord, {q(P.MARKER_KNOWLEDGE)} AS marker, CASE WHEN lead_para > first THEN first ELSE 1 END AS start_para, CASE WHEN lead_para > first THEN lead_para - 1 ELSE 0 END AS end_para, last FROM z1
  UNION ALL SELECT doc_id, 2, CASE WHEN advanced IS NULL AND lead_role = 'advanced_practice' THEN {q(P.MARKER_CONSOLIDATION)} ELSE {q(P.MARKER_DRILL)} END, CASE WHEN advanced IS NULL THEN lead_para ELSE basic END, CASE WHEN advanced IS NULL THEN last ELSE advanced - 1 END, last FROM z1
  UNION ALL SELECT doc_id, 3, {q(P.MARKER_CONSOLIDATION)}, advanced, last, last FROM z1 WHERE advanced IS NOT NULL),
{protected_sql("mb")}"""


RENUMBERED = f"SELECT doc_id, para, CASE WHEN {rx(P.EXAM_QUESTION)} THEN regexp_replace(text, '^(\\s*)\\p{{Nd}}{{1,3}}', concat('\\1', CAST(row_number() OVER (PARTITION BY doc_id, {rx(P.EXAM_QUESTION)} ORDER BY para) AS VARCHAR))) ELSE text END AS text FROM c"
MANIFESTS = "m AS (" + corpora.MANIFESTS.replace("{orders}", "orders") + ")"
BASE = "regexp_extract(replace(name, chr(92), '/'), '[^/]*$')"
IS_DOCX = f"lower(name) LIKE '%.docx' AND NOT starts_with({BASE}, '~$')"
CHECKED = f"""WITH {MANIFESTS}, b AS (SELECT job_id, pos, {BASE} AS name FROM m),
k AS (SELECT *, CASE WHEN name = '' OR starts_with(name, '~$') OR NOT regexp_matches(lower(name), '\\.(zip|docx)$') THEN {q(P.BAD_KIND)} WHEN row_number() OVER (PARTITION BY job_id, lower(name) ORDER BY pos) > 1 THEN {q(P.SAME_NAME)} END AS error FROM b)"""
VERSIONS = f"""WITH {MANIFESTS}, d AS (SELECT *, {rx("|".join(P.TEACHER_WORDS), BASE)} AS is_t, {rx("|".join(P.STUDENT_WORDS), BASE)} AS is_s FROM m WHERE {IS_DOCX}),
t AS (SELECT job_id, min(pos) FILTER (is_t) AS tp, list(name ORDER BY size DESC, pos) AS by_size FROM d GROUP BY job_id),
u AS (SELECT t.job_id, by_size, coalesce(arg_min(name, pos) FILTER (pos = tp), by_size[1]) AS teacher, arg_min(name, pos) FILTER (is_s AND pos IS DISTINCT FROM tp) AS s FROM t JOIN d USING (job_id) GROUP BY t.job_id, by_size, tp)
SELECT job_id, teacher, coalesce(s, list_filter(by_size, lambda n: n <> teacher)[1]) AS student FROM u"""


def topic_sql(column: str) -> str:
    noise = "[" + ", ".join(q(w) for w in sorted(P.TOPIC_NOISE, key=len, reverse=True)) + "]"
    known = f"list_contains({noise}, p)"
    bare = f"regexp_replace(regexp_extract({column}, '[^/]*$'), {q(P.EXTENSION)}, '\\1')"
    part = f"list_reduce(list_prepend(p, {noise}), lambda a, w: replace(a, w, ''))"
    clean = f"trim(regexp_replace(regexp_replace({part}, {q(P.TOPIC_PART)}, '', 'g'), {q(P.TOPIC_EDGE_PART)}, '', 'g'), ' ')"
    parts = f"list_filter(list_transform(list_filter(regexp_split_to_array(regexp_replace({bare}, {q(P.TOPIC_WHOLE)}, ' ', 'g'), {q(P.TOPIC_SPLIT)}), lambda p: p <> '' AND NOT {known}), lambda p: {clean}), lambda p: p <> '' AND NOT {known})"
    left = f"array_to_string({parts}, ' ')"
    for pattern in P.TOPIC_LEFT:
        left = f"regexp_replace({left}, {q(pattern)}, '', 'g')"
    return f"coalesce(nullif(trim(regexp_replace({left}, {q(P.TOPIC_EDGE)}, '', 'g'), ' '), ''), {bare})"


def topped(column: str, n: int) -> str:
    return f"list_slice(list_filter(coalesce({column}, []), lambda x, i: list_position({column}, x) = i), 1, {n})"


FEATURES = f"""WITH {C2}, k0 AS (SELECT *, regexp_extract(text, {q(P.OBJECTIVE_ORDERED)}, 1) AS ordered FROM c),
k1 AS (SELECT *, CASE WHEN text = '' THEN NULL WHEN {rx(P.TYPE_MARKER)} THEN 'type' WHEN {rx(P.OBJECTIVE_KNOWLEDGE)} THEN 'knowledge' WHEN ordered <> '' THEN 'ordered' WHEN {rx(P.NUMBER)} THEN 'question' ELSE 'other' END AS kind FROM k0),
k2 AS (SELECT *, CASE kind WHEN 'type' THEN trim(regexp_replace(regexp_replace(text, {q(P.OBJECTIVE_TYPE)}, ''), '^[【】]+|[【】]+$', '', 'g'), ' ') WHEN 'knowledge' THEN regexp_replace(trim(regexp_replace(text, {q(P.OBJECTIVE_KNOWLEDGE)}, ''), ' '), '^[：:、 ]+', '') WHEN 'ordered' THEN CASE WHEN {" OR ".join(f"contains(ordered, {q(w)})" for w in P.OBJECTIVE_EXCLUDED)} THEN NULL ELSE trim(ordered, ' ') END END AS title,
  CASE WHEN kind = 'other' THEN CASE {" ".join(f"WHEN contains(text, {q(w)}) THEN {q(w)}" for w in P.OBJECTIVE_TAGS)} END END AS tag FROM k1),
k3 AS (SELECT doc_id, list(title ORDER BY para) FILTER (kind IN ('knowledge', 'ordered') AND length(title) BETWEEN 1 AND 29) AS kn, list(title ORDER BY para) FILTER (kind = 'type' AND length(title) BETWEEN 1 AND 29) AS ty, list(tag ORDER BY para) FILTER (tag IS NOT NULL) AS ta,
  list({number(f"regexp_extract(text, {q(P.NUMBER)}, 1)")} ORDER BY para) FILTER (kind = 'question') AS nums, CAST(count(*) FILTER (kind = 'other' AND {rx(P.OBJECTIVE_EXAMPLE)}) AS INT) AS examples FROM k2 GROUP BY doc_id),
fe AS (SELECT doc_id, {topped("kn", 3)} AS knowledge, {topped("ty", 3)} AS types, {topped("ta", 2)} AS tags, CAST(list_reduce(list_prepend(0, coalesce(nums, [])), lambda a, b: CASE WHEN b = a + 1 THEN b ELSE a END) AS INT) AS questions, examples FROM k3)"""


def worded_sql(key: str, **values: str) -> str:
    out, left = [], P.OBJECTIVE_TEXTS[key]
    while "{" in left:
        before, _, rest = left.partition("{")
        name, _, left = rest.partition("}")
        out += [q(before), values[name]]
    return "concat(" + ", ".join([*out, q(left)]) + ")"


OBJECTIVES = f"""{FEATURES}, o AS (SELECT *, concat('专题', doc_id) AS topic, CASE WHEN len(types) > 0 THEN types ELSE tags END AS names FROM fe),
p AS (SELECT *, concat(array_to_string(names, '、'), '等') AS listed, CASE WHEN len(names) > 0 THEN concat(array_to_string(names, '、'), '等') ELSE {q(P.OBJECTIVE_TEXTS["any_part"])} END AS part FROM o)
SELECT doc_id, concat_ws(chr(10), CASE WHEN len(knowledge) > 0 THEN {worded_sql("knowledge", topic="topic", names="array_to_string(knowledge, '、')")} ELSE {worded_sql("no_knowledge", topic="topic")} END, CASE WHEN questions > 0 THEN {worded_sql("counted", part="part", count="questions")} ELSE {worded_sql("uncounted", part="part")} END, {q(P.OBJECTIVE_TEXTS["skills"])}) AS objectives,
  concat_ws(chr(10), CASE WHEN len(knowledge) > 0 THEN {worded_sql("key", topic="topic", names="array_to_string(knowledge[1:2], '、')")} ELSE {worded_sql("no_key", topic="topic")} END, CASE WHEN len(names) > 0 THEN {worded_sql("hard", part="listed")} ELSE {q(P.OBJECTIVE_TEXTS["no_hard"])} END) AS difficulties FROM p"""

SMART = f"""WITH {C2}, tt AS ({contents_sql(C2)} SELECT * FROM pr), aa AS ({AUTO}),
sm AS (SELECT doc_id, 'toc' AS tier, ord, marker, start_para, end_para FROM tt UNION ALL SELECT doc_id, tier, ord, marker, start_para, end_para FROM aa WHERE doc_id NOT IN (SELECT doc_id FROM tt)),
{refine_sql("sm")} {refined_sql("sm", "tier,")}"""


def drawn_sql(name: str, sql: str) -> str:
    return f"{name} AS (" + sql.replace("{handouts}", corpora.HANDOUTS).replace("{lineitem}", "lineitem").replace("{orders}", "orders").replace("{{", "{").replace("}}", "}") + ")"


TABLES_SQL = f"""{drawn_sql("ts", corpora.TABLES)},
ti AS (SELECT doc_id, min(start_para) AS s, max(end_para) AS e FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY start_para, end_para ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN start_para <= max(end_para) OVER (PARTITION BY doc_id ORDER BY start_para, end_para ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM ts)) GROUP BY doc_id, island)"""


def widened_sql(blocks: str) -> str:
    """Blocks widened to whole tables, by looking each end up among the islands."""
    filled = "start_para > 0 AND end_para >= start_para"
    at = lambda c, to: f"CAST(CASE WHEN {filled} THEN coalesce((SELECT {to} FROM ti WHERE ti.doc_id = b.doc_id AND b.{c} BETWEEN s AND e), {c}) ELSE {c} END AS INT) AS {c}"
    return f"SELECT doc_id, ord, marker, {at('start_para', 's')}, {at('end_para', 'e')} FROM {blocks} b"


#: Which template a handout is filled into, and its markers in it.
TEMPLATE_OF = "CASE doc_id % 3 WHEN 0 THEN '1v1' WHEN 1 THEN 'class' ELSE 'short' END"
MARKER_OF = f"CASE WHEN doc_id % 3 = 1 AND marker = {q(P.MARKER_KNOWLEDGE)} THEN {q(P.CLASS_KNOWLEDGE)} WHEN doc_id % 3 = 1 AND marker = {q(P.MARKER_CONSOLIDATION)} THEN {q(P.CLASS_CONSOLIDATION)} ELSE marker END"
FILLED = boundary_sql(C2) + f""", bb AS ({BLOCKS}), {TABLES_SQL}, wb AS ({widened_sql("bb")}), tp AS ({corpora.TEMPLATES}), mk AS ({corpora.MARKERS}),
tb AS (SELECT doc_id, {TEMPLATE_OF} AS template, ord, {MARKER_OF} AS marker, start_para, end_para FROM wb),
an AS (SELECT template, marker, CAST(min(pos) AS INT) AS anchor FROM tp JOIN mk USING (template) WHERE starts_with(text, marker) GROUP BY template, marker),
fb AS (SELECT tb.*, anchor FROM tb JOIN an USING (template, marker) WHERE start_para > 0 AND end_para >= start_para),
fr AS (SELECT doc_id, CAST(pos AS INT) AS anchor, 0 AS layer, 0 AS turn, CAST(pos AS INT) AS para, text FROM (SELECT DISTINCT doc_id, template FROM tb) JOIN tp USING (template)
  UNION ALL SELECT c.doc_id, anchor, 1, -ord, para, text FROM c JOIN fb ON fb.doc_id = c.doc_id AND para BETWEEN start_para AND end_para),
fi AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY anchor, layer, turn, para) AS INT) AS pos, CASE layer WHEN 0 THEN 'template' ELSE 'source' END AS origin, para, text FROM fr)
"""
TRIMMED = f""", fo AS (SELECT *, coalesce(min(CASE WHEN contains(text, {q(P.MARKER_KNOWLEDGE)}) THEN pos END) OVER (PARTITION BY doc_id), max(pos) OVER (PARTITION BY doc_id)) AS opens, lead(text) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM fi)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INT) AS pos, origin, para, text FROM fo WHERE pos < opens OR NOT (text = '' AND coalesce(nxt = '', false))"""

FIELDS = f"fl AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '物理' WHEN 1 THEN '数学' WHEN 2 THEN '' END AS subject, CASE WHEN doc_id % 5 > 0 THEN '高一' END AS grade, concat('专题', doc_id) AS topic, '复习讲义' AS handout_type, objectives, difficulties FROM ({OBJECTIVES}))"
COVER_CELLS = f"WITH {FIELDS} SELECT doc_id, unnest([{', '.join(str(r) for r, _ in filling.CELLS.values())}]) AS row, unnest([{', '.join(str(c) for _, c in filling.CELLS.values())}]) AS col, unnest([{', '.join((q(filling.SUBJECT) + ' || ' if k == 'subject' else '') + f'coalesce({k}, {q('')})' for k in filling.CELLS)}]) AS text FROM fl"
_COVERED = reduce(lambda t, k: f"CASE WHEN coalesce({k}, '') <> '' THEN replace({t}, {q(filling.PLACEHOLDERS[k])}, {k}) ELSE {t} END", [k for k in filling.PLACEHOLDERS if k != "authors"], "fi.text")
COVER_ROWS = FILLED + f", {FIELDS} SELECT fi.doc_id, pos, origin, para, CASE WHEN origin = 'template' THEN {_COVERED} ELSE fi.text END AS text FROM fi LEFT JOIN fl USING (doc_id)"

#: What may be named in a reply, and replies as JSON.
MAY = f""", may AS (SELECT doc_id, kind, para FROM ca UNION SELECT doc_id, 'practice_start', p_para FROM ch WHERE p_para IS NOT NULL UNION SELECT doc_id, 'consolidation_start', c.para FROM ch WHERE p_para IS NOT NULL AND c IS NOT NULL)"""
REVIEW_SAMPLE = CANDIDATES + f""", ce AS (SELECT doc_id, para FROM rk WHERE place <= 5 UNION SELECT doc_id, p_para FROM ch WHERE p_para IS NOT NULL UNION SELECT doc_id, c.para FROM ch WHERE p_para IS NOT NULL AND c IS NOT NULL)
SELECT doc_id, para, {short_sql("text", 120)} AS head FROM c WHERE text <> '' AND EXISTS (SELECT 1 FROM ce WHERE ce.doc_id = c.doc_id AND abs(ce.para - c.para) <= 10)"""


def json_sql(column: str) -> str:
    found = f"regexp_extract({column}, {q(r'(?s)\{.*\}')})"
    return f"CASE WHEN {found} <> '' THEN {found} ELSE {column} END"


CANDIDATE_BLOCKS = f", k0 AS (SELECT doc_id, first, last, coalesce(p_para, first + CAST(trunc((last - first) * 0.5::DOUBLE) AS INT)) AS p0, c.para AS c0 FROM ch), k1 AS (SELECT *, greatest(first, least(p0, last)) AS p, coalesce(c0, p0 + CAST(trunc((last - p0) * 0.7::DOUBLE) AS INT)) AS c1 FROM k0), k AS (SELECT *, CASE WHEN p < last THEN greatest(p + 1, least(c1, last)) ELSE last END AS c FROM k1), kb AS (SELECT doc_id, 1 AS ord, {q(P.MARKER_KNOWLEDGE)} AS marker, first AS start_para, CAST(greatest(first, p - 1) AS INT) AS end_para FROM k UNION ALL SELECT doc_id, 2, {q(P.MARKER_DRILL)}, CAST(p AS INT), CAST(greatest(p, c - 1) AS INT) FROM k UNION ALL SELECT doc_id, 3, {q(P.MARKER_CONSOLIDATION)}, CAST(c AS INT), last FROM k)"
REVIEWED = CANDIDATES + MAY + f""", {drawn_sql("rp", corpora.REPLIES)}, rj AS (SELECT doc_id, {json_sql("reply")} AS j FROM rp),
rv AS (SELECT doc_id, TRY_CAST(json_extract_string(j, 'practice_start') AS INT) AS p, TRY_CAST(json_extract_string(j, 'consolidation_start') AS INT) AS c FROM (SELECT doc_id, CASE WHEN json_valid(j) THEN j END AS j FROM rj)),
ok2 AS (SELECT rv.doc_id, rv.p, rv.c, first, last FROM rv JOIN e0 USING (doc_id) WHERE p < rv.c AND first < p AND rv.c <= last AND EXISTS (SELECT 1 FROM may m WHERE m.doc_id = rv.doc_id AND m.kind = 'practice_start' AND m.para = rv.p) AND EXISTS (SELECT 1 FROM may m WHERE m.doc_id = rv.doc_id AND m.kind = 'consolidation_start' AND m.para = rv.c))
{CANDIDATE_BLOCKS}
SELECT doc_id, 'review' AS source, 1 AS ord, {q(P.MARKER_KNOWLEDGE)} AS marker, first AS start_para, CAST(p - 1 AS INT) AS end_para FROM ok2
UNION ALL SELECT doc_id, 'review', 2, {q(P.MARKER_DRILL)}, p, CAST(c - 1 AS INT) FROM ok2
UNION ALL SELECT doc_id, 'review', 3, {q(P.MARKER_CONSOLIDATION)}, c, last FROM ok2
UNION ALL SELECT doc_id, 'offline', ord, marker, start_para, end_para FROM kb WHERE doc_id NOT IN (SELECT doc_id FROM ok2)"""
REPLY_BLOCKS = f"""WITH {C2}, {drawn_sql("rp", corpora.BLOCK_REPLIES)}, rj AS (SELECT doc_id, {json_sql("reply")} AS j FROM rp),
rb AS (SELECT doc_id, generate_subscripts(l, 1) AS nth, unnest(l) AS b FROM (SELECT doc_id, CAST(json_extract(j, '$.blocks') AS JSON[]) AS l FROM rj WHERE json_valid(j))),
rs AS (SELECT doc_id, nth, json_extract_string(b, 'type') AS kind, TRY_CAST(json_extract_string(b, 'start_para') AS INT) AS start FROM rb),
rl AS (SELECT doc_id, kind, arg_max(start, nth) AS start, min(nth) AS nth FROM rs WHERE kind <> '' AND start > 0 GROUP BY doc_id, kind),
re AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, lead(start) OVER (PARTITION BY doc_id ORDER BY start, nth) - 1 AS stop FROM rl)
SELECT re.doc_id, CASE kind WHEN 'knowledge' THEN 1 WHEN 'practice' THEN 2 ELSE 3 END AS ord, CASE kind WHEN 'knowledge' THEN {q(P.MARKER_KNOWLEDGE)} WHEN 'practice' THEN {q(P.MARKER_DRILL)} ELSE {q(P.MARKER_CONSOLIDATION)} END AS marker, start AS start_para, CAST(coalesce(stop, last) AS INT) AS end_para
FROM re JOIN (SELECT doc_id, max(para) AS last FROM c GROUP BY doc_id) USING (doc_id) WHERE n >= 2 AND kind IN ('knowledge', 'practice', 'consolidation') AND coalesce(stop, last) >= start"""
OBJECTIVES_SAMPLE = f"""WITH {C1}, l AS (SELECT doc_id, para, substring(text, 1, 100) AS line FROM (SELECT *, row_number() {W} AS nth FROM c) WHERE nth <= 150 AND text <> ''),
s AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY para) AS sample FROM l GROUP BY doc_id) SELECT doc_id, substring(sample, 1, 3000) AS sample FROM s"""


def red_sql(c: str) -> str:
    """RRGGBB that reads as red, digit by digit."""
    part = lambda k: f"(16 * (strpos('0123456789ABCDEF', upper(substring({c}, {k}, 1))) - 1) + strpos('0123456789ABCDEF', upper(substring({c}, {k + 1}, 1))) - 1)"
    return f"regexp_matches(coalesce({c}, ''), '^[0-9A-Fa-f]{{6}}$') AND {part(1)} >= 100 AND {part(3)} <= 70 AND {part(5)} <= 70"


MIGRATED = f"""WITH {drawn_sql("ow", corpora.OWN_RELATIONS)}, {drawn_sql("tk", corpora.TAKEN_RELATIONS)},
hd AS (SELECT package, kind, target, min(rid) AS own_rid FROM ow GROUP BY ALL),
fs AS (SELECT package, kind, target, min({{'s': source, 'a': nth, 'r': rid}}) AS f FROM tk GROUP BY ALL),
fk AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY f, kind, target) AS k FROM fs WHERE NOT EXISTS (SELECT 1 FROM hd WHERE hd.package = fs.package AND hd.kind = fs.kind AND hd.target = fs.target)),
nk AS (SELECT package, list(k) AS ks FROM fk GROUP BY package),
us AS (SELECT package, list(DISTINCT CAST(regexp_extract(rid, '^rId([1-9][0-9]*)$', 1) AS INT)) AS used FROM ow WHERE regexp_matches(rid, '^rId[1-9][0-9]*$') GROUP BY package),
fr AS (SELECT package, list_filter(range(1, len(ks) + len(coalesce(used, [])) + 1), lambda x: NOT list_contains(coalesce(used, []), x)) AS free FROM nk LEFT JOIN us USING (package)),
nw AS (SELECT fk.*, concat('rId', free[k]) AS fresh FROM fk JOIN fr USING (package))
SELECT DISTINCT tk.package, source, rid, coalesce(own_rid, fresh) AS new_rid FROM tk LEFT JOIN hd USING (package, kind, target) LEFT JOIN nw USING (package, kind, target)"""

SMART_HANDOUTS = f"""WITH {C2}, tt AS ({contents_sql(C2)} SELECT * FROM pr), aa AS ({AUTO}),
sm AS (SELECT doc_id, 'toc' AS tier, ord, marker, start_para, end_para FROM tt UNION ALL SELECT doc_id, tier, ord, marker, start_para, end_para FROM aa WHERE doc_id NOT IN (SELECT doc_id FROM tt)),
{refine_sql("sm")} {refined_sql("sm", "")}"""
CANDIDATE_MODE = CANDIDATES + f"{CANDIDATE_BLOCKS}, mb AS (SELECT kb.*, last FROM kb JOIN e0 USING (doc_id)), {READING_SQL}, {protected_sql('mb')} SELECT * FROM pr"
VERSION_BLOCKS = f"""WITH {C2}, {drawn_sql("vs", corpora.VERSIONS)}, fl AS (SELECT doc_id, 1 AS ord, {q(P.MARKER_KNOWLEDGE)} AS marker, CAST(min(para) AS INT) AS start_para, CAST(max(para) AS INT) AS end_para FROM c GROUP BY doc_id),
id AS ({IDEAL}), cm AS ({CANDIDATE_MODE}), sb AS ({SMART_HANDOUTS}),
al AS (SELECT 'full' AS mode, * FROM fl UNION ALL SELECT 'ideal', * FROM id UNION ALL SELECT 'ideal', * FROM sb WHERE doc_id NOT IN (SELECT doc_id FROM id) UNION ALL SELECT 'candidate', * FROM cm UNION ALL SELECT 'smart', * FROM sb)
SELECT version_id, vs.mode, CASE WHEN vs.mode NOT IN ('full', 'ideal', 'candidate', 'smart') THEN 'no such mode' WHEN vs.doc_id NOT IN (SELECT doc_id FROM fl) THEN 'no source' ELSE 'ok' END AS status, ord, marker, start_para, end_para FROM vs LEFT JOIN al ON al.doc_id = vs.doc_id AND al.mode = vs.mode"""


def over(corpus, operator):
    return lambda spark, sf_dir: operator(corpus(spark, sf_dir))


def read(name, operator):
    return lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def outline(paras):
    return paras.filter((F.col("text") != "") & ((F.col("para") <= 60) | (F.length("text") < 50))).select("doc_id", "para", F.substring("text", 1, 80).alias("head"))


#: Templates of a category.
TEMPLATES = 3


def similarity(vectors):
    """Each vector's likeness to the templates, the first vectors of each label: the best category."""
    first = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    templates = vectors.withColumn("at", first).filter(F.col("at") <= TEMPLATES).select(F.col("label").alias("category"), F.col("embedding").alias("template"))
    return likeness.best_category(vectors.select("vec_id", "embedding"), templates).select("vec_id", "category", "similarity")


def counters(spark, sf_dir):
    """For each document how many runs are red, how many paragraphs go with answers, and how many questions ask for space."""
    runs, paras = corpora.runs(spark, sf_dir), corpora.handouts(spark, sf_dir)
    red = runs.groupBy("doc_id").agg(F.count_if(scalars.is_red(F.col("colour"))).alias("red_runs"))
    gone = rows.answer_ranges(paras).groupBy("doc_id").agg(F.sum(F.expr("end_para - start_para + 1")).alias("answer_rows"))
    asked = rows.question_kinds(paras).groupBy("doc_id").agg(F.count_if(F.col("kind") == "short").alias("short_questions"), F.count_if(F.col("kind") == "blank").alias("blank_questions"))
    return red.join(gone, "doc_id", "left").join(asked, "doc_id", "left").fillna(0)


def group_lines(paras):
    """A line for each example group, as its report has them, in one text for each document."""
    line = F.concat(F.lit(P.GROUP_LINE), F.col("start_para").cast("string"), F.lit(".."), F.col("end_para").cast("string"))
    ordered = F.array_sort(F.collect_list(F.struct("start_para", line.alias("line"))))
    return tiers.example_groups(paras).groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("summary"))


def knowledge(paras):
    return paras.filter(scoring.knowing(F.col("text"))).select("doc_id", "para")


def scored_blocks(paras):
    return segments.blocks(segments.boundaries(paras))


def with_pictures(paras):
    """Boundaries with the pictures that stand in paragraphs without words, from the same pass."""
    pictures = F.collect_list(F.when(F.col("has_img") & F.col("_decor"), F.col("para"))).alias("pictures")
    return segments.boundaries(paras, {"pictures": pictures}, {"_decor": P.DECOR})


def candidate_query(operator):
    return over(corpora.handouts, lambda p: operator(candidates.collected(p)))


def dense(found):
    return candidates.each(found).filter("c.source = 'question_density'").select("doc_id", "c.para")


def practice_boundary(paras):
    blocks = scored_blocks(paras)
    practice = blocks.filter(F.col("ord") > 1).filter("start_para <= end_para")
    return rows.practice_boundary(paras, practice.groupBy("doc_id").agg(F.min_by("start_para", "ord").alias("start_para"), F.max("end_para").alias("end_para")))


def features(paras):
    joined = [F.array_join(c, "、").alias(c) for c in ("knowledge", "types", "tags")]
    return objectives.features(paras).select("doc_id", *joined, "questions", "examples")


def toc_entries(paras):
    return contents.entries(paras).select("doc_id", "toc_end", F.explode("entries").alias("e")).select("doc_id", "toc_end", "e.*")


def contents_lines(orders):
    """Lines as tables of contents have them: names, leader dots and page numbers."""
    line = F.concat(F.trim("o_orderpriority"), F.repeat(F.lit("."), (F.col("o_orderkey") % 9).cast("int")), F.lit(" "), F.col("o_custkey").cast("string"))
    return orders.select("o_orderkey", scalars.clean_toc_name(line).alias("name"))


def roles(paras):
    return paras.withColumn("role", scalars.toc_role(F.col("text"))).filter("role IS NOT NULL").select("doc_id", "para", "role")


def filename(orders):
    """year_priority_status_version.docx, without the parts that are empty."""
    year = scalars.academic_year(F.col("o_orderdate"))
    return orders.select("o_orderkey", F.concat(scalars.file_base(year, F.trim("o_orderpriority"), F.nullif(F.col("o_orderstatus"), F.lit("O"))), F.lit("_教师版.docx")).alias("filename"))


def templated(blocks):
    """Blocks with the template that their document is filled into, and its markers."""
    template = F.when(F.col("doc_id") % 3 == 0, "1v1").when(F.col("doc_id") % 3 == 1, "class").otherwise("short")
    marker = F.when(F.col("template") == "class", assembly.class_marker(F.col("marker"))).otherwise(F.col("marker"))
    return blocks.withColumn("template", template).withColumn("marker", marker)


def with_tables(spark, sf_dir):
    """The handouts, and their scored blocks widened to whole tables."""
    paras = corpora.handouts(spark, sf_dir)
    return paras, filling.widened(scored_blocks(paras), corpora.tables(spark, sf_dir))


def filled(spark, sf_dir):
    paras, blocks = with_tables(spark, sf_dir)
    templates = corpora.templates(spark)
    return filling.filled_rows(paras, templated(blocks), templates, filling.anchors(templates, corpora.markers(spark)))


def fields(paras):
    """The fields of a handout's cover."""
    made = objectives.objectives(objectives.features(paras), F.concat(F.lit("专题"), F.col("doc_id").cast("string")))
    subject = F.when(F.col("doc_id") % 4 == 0, "物理").when(F.col("doc_id") % 4 == 1, "数学").when(F.col("doc_id") % 4 == 2, "")
    return made.withColumns({"subject": subject, "grade": F.when(F.col("doc_id") % 5 > 0, "高一"), "topic": F.concat(F.lit("专题"), F.col("doc_id").cast("string")), "handout_type": F.lit("复习讲义")})


def missing(spark, sf_dir):
    return filling.missing_anchors(templated(with_tables(spark, sf_dir)[1]), filling.anchors(corpora.templates(spark), corpora.markers(spark)))


QUERIES = {
    "split_blocks_scored": over(corpora.handouts, lambda p: segments.blocks(segments.boundaries(p))),
    # the windows need this shuffle anyway; before the patterns run, it also spreads a file of few row groups
    "split_blocks_documents": over(corpora.documents, lambda p: segments.blocks(segments.boundaries(p.repartition("doc_id")))),
    "find_boundary": over(corpora.handouts, lambda p: segments.boundaries(p).filter("boundary IS NOT NULL").select("doc_id", F.col("boundary").cast("int").alias("boundary"))),
    "numbered_positions": over(corpora.handouts, lambda p: segments.boundaries(p).select("doc_id", F.explode("points").alias("para"))),
    "para_scores": over(corpora.documents, lambda p: scoring.scored(p.repartition("doc_id")).select("doc_id", "para", "q", "k", "is_boundary", "section_type")),
    "handout_scores": over(corpora.handouts, lambda p: scoring.scored(p).select("doc_id", "para", "q", "k", "is_boundary", "section_type")),
    "type_positions": over(corpora.handouts, scoring.type_positions),
    "scan_grep": over(corpora.handouts, lambda p: p.filter(F.col("text").rlike("定义.*[0-9]")).select("doc_id", "para", F.substring("text", 1, 80).alias("head"))),
    "scan_outline": over(corpora.documents, outline),
    "full_split": over(corpora.documents, rows.extent),
    "question_spans": over(corpora.handouts, rows.question_spans),
    "question_kinds": over(corpora.handouts, rows.question_kinds),
    "compress_blanks": over(corpora.handouts, lambda p: rows.compress_blanks(p).select("doc_id", "para", "text", "has_img")),
    "renumber": over(corpora.handouts, rows.renumber),
    "position_ratio": over(corpora.documents, rows.position_ratio),
    "gap_runs": over(corpora.handouts, lambda p: rows.gap_runs(p.filter(scoring.knowing(F.col("text"))).select("doc_id", "para"))),
    "pair_examples": over(corpora.handouts, lambda p: assembly.paired(rows.gap_runs(knowledge(p)), p.filter(F.col("text").rlike("^【例 *[0-9]+】"))).fillna(0, ["example"])),
    "validate_blocks": over(corpora.handouts, lambda p: assembly.validated_rows(segments.gathered(segments.boundaries(p)))),
    "assemble_rows": over(corpora.handouts, lambda p: assembly.assembled(p, scored_blocks(p))),
    "filename": read("orders", filename),
    "answer_delete_ranges": over(corpora.handouts, rows.answer_ranges),
    "student_rows": over(corpora.handouts, rows.student_rows),
    "answer_space": over(corpora.handouts, lambda p: rows.answer_space(rows.student_rows(p))),
    "student_version": over(corpora.runs, rows.student_version),
    "class_blocks": over(corpora.handouts, lambda p: assembly.for_class(scored_blocks(p))),
    "question_density": candidate_query(dense),
    "practice_boundary": over(corpora.handouts, practice_boundary),
    "hybrid_classes": over(corpora.handouts, hybrid.classified),
    "hybrid_split": over(corpora.handouts, hybrid.split),
    "example_rows": over(corpora.handouts, tiers.without_examples),
    "ideal_rows": over(corpora.handouts, lambda p: rows.renumber(tiers.without_examples(p))),
    "upload_checks": over(corpora.manifests, manifests.checked),
    "upload_errors": over(corpora.manifests, manifests.accepted),
    "upload_inputs": over(corpora.manifests, manifests.inputs),
    "file_versions": over(corpora.manifests, manifests.versions),
    "topic": over(corpora.manifests, lambda f: f.select("job_id", "pos", scalars.topic(F.col("name")).alias("topic"))),
    "objective_features": over(corpora.handouts, features),
    "objectives": over(corpora.handouts, lambda p: objectives.objectives(objectives.features(p), F.concat(F.lit("专题"), F.col("doc_id").cast("string")))),
    "short_text": over(corpora.documents, lambda p: p.select("doc_id", "para", scalars.short(F.col("text"), 80).alias("head"))),
    "academic_year": read("orders", lambda o: o.select("o_orderkey", scalars.academic_year(F.col("o_orderdate")).alias("academic_year"))),
    "is_red": read("orders", lambda o: o.withColumn("colour", F.lpad(F.hex(F.col("o_orderkey") * 7919 % 16777216), 6, "0")).select("o_orderkey", "colour", scalars.is_red(F.col("colour")).alias("is_red"))),
    "template_similarity": read("embeddings", similarity),
    "auto_split": over(corpora.handouts, tiers.auto_split),
    "reading_spans": over(corpora.handouts, tiers.reading_spans),
    "image_fix": over(corpora.handouts, lambda p: tiers.pictured(segments.gathered(with_pictures(p)))),
    "example_groups": over(corpora.handouts, tiers.example_groups),
    "ideal_split": over(corpora.handouts, tiers.ideal_split),
    "candidates": candidate_query(candidates.merged),
    "candidate_choice": candidate_query(candidates.choice),
    "candidate_blocks": candidate_query(candidates.candidate_blocks),
    "needs_review": candidate_query(candidates.review),
    "candidate_report": candidate_query(candidates.report),
    "para_count": over(corpora.documents, lambda p: p.groupBy("doc_id").agg(F.count("*").alias("n"))),
    "clean_toc_name": read("orders", contents_lines),
    "toc_role": over(corpora.handouts, roles),
    "toc_entries": over(corpora.with_contents, toc_entries),
    "toc_headings": over(corpora.handouts, lambda p: contents.headings(p).select("doc_id", F.explode("entries").alias("e")).select("doc_id", "e.*")),
    "toc_split": over(corpora.with_contents, contents.split),
    "smart_split": over(corpora.with_contents, contents.smart_split),
    "smart_blocks": over(corpora.with_contents, contents.smart_blocks),
    "hybrid_tiers": over(corpora.handouts, lambda p: contents.smart_split(p, hybrid_first=True)),
    "refined_blocks": over(corpora.handouts, lambda p: rows.refined(scored_blocks(p), p)),
    "table_islands": lambda spark, sf_dir: filling.table_islands(corpora.tables(spark, sf_dir)),
    "blocks_widened": lambda spark, sf_dir: with_tables(spark, sf_dir)[1],
    "filled_rows": filled,
    "filled_trimmed": lambda spark, sf_dir: filling.trimmed(filled(spark, sf_dir)),
    "missing_anchors": missing,
    "cover_cells": over(corpora.handouts, lambda p: filling.cover_cells(fields(p))),
    "cover_rows": lambda spark, sf_dir: filling.covered(filled(spark, sf_dir), fields(corpora.handouts(spark, sf_dir))),
    "full_report": candidate_query(candidates.full_report),
    "review_sample": over(corpora.handouts, lambda p: replies.review_sample(p, candidates.collected(p))),
    "reviewed_blocks": lambda spark, sf_dir: replies.reviewed_blocks(candidates.collected(corpora.handouts(spark, sf_dir)), corpora.replies(spark, sf_dir)),
    "reply_blocks": lambda spark, sf_dir: replies.reply_blocks(corpora.block_replies(spark, sf_dir), rows.extent(corpora.handouts(spark, sf_dir))),
    "objectives_sample": over(corpora.documents, replies.objectives_sample),
    "split_sample": over(corpora.documents, replies.split_sample),
    "candidate_mode": over(corpora.handouts, versions.candidate_mode),
    "block_errors": lambda spark, sf_dir: assembly.errors(corpora.faulty_blocks(spark, sf_dir), rows.extent(corpora.handouts(spark, sf_dir))),
    "counters": counters,
    "group_lines": over(corpora.handouts, group_lines),
    "upload_totals": over(corpora.manifests, manifests.totals),
    "upload_options": lambda spark, sf_dir: manifests.jobs_checked(corpora.jobs(spark, sf_dir), corpora.manifests(spark, sf_dir)),
    "cleaned_text": over(corpora.marked, lambda p: p.select("doc_id", "para", scalars.cleaned(F.col("text")).alias("text"))),
    "log_counters": over(corpora.logs, lambda l: l.select("job_id", *(scalars.counter(F.col("log"), k).alias(k.lower()) for k in ("RED", "DELETED", "BLANKS")))),
    "version_blocks": lambda spark, sf_dir: versions.version_blocks(corpora.versions(spark, sf_dir), corpora.handouts(spark, sf_dir)),
    "migrated_relations": lambda spark, sf_dir: relations.migrated(corpora.own_relations(spark, sf_dir), corpora.taken_relations(spark, sf_dir)),
}

ORACLES = {
    "split_blocks_scored": boundary_sql(C2) + BLOCKS,
    "split_blocks_documents": boundary_sql(C1) + BLOCKS,
    "find_boundary": boundary_sql(C2) + "SELECT doc_id, CAST(boundary AS INT) AS boundary FROM d2 WHERE boundary IS NOT NULL",
    "numbered_positions": boundary_sql(C2) + "SELECT doc_id, para FROM pts",
    "para_scores": f"WITH {C1} SELECT doc_id, para, {weights(P.QUESTION)} AS q, {weights(P.KNOWLEDGE)} AS k, {BOUND} AS is_boundary, {SECTION} AS section_type FROM c",
    "handout_scores": f"WITH {C2} SELECT doc_id, para, {weights(P.QUESTION)} AS q, {weights(P.KNOWLEDGE)} AS k, {BOUND} AS is_boundary, {SECTION} AS section_type FROM c",
    "type_positions": f"WITH {C2} SELECT doc_id, {number(f"regexp_extract(text, {q(P.TYPE_MARKER)}, 1)")} AS type_no, max(para) AS para FROM c WHERE {rx(P.TYPE_MARKER)} GROUP BY ALL",
    "scan_grep": f"WITH {C2} SELECT doc_id, para, substring(text, 1, 80) AS head FROM c WHERE {rx('定义.*[0-9]')}",
    "scan_outline": f"WITH {C1} SELECT doc_id, para, substring(text, 1, 80) AS head FROM c WHERE text <> '' AND (para <= 60 OR length(text) < 50)",
    "full_split": f"WITH {C1} SELECT doc_id, min(para) AS start_para, max(para) AS end_para, count(*) AS n_paras FROM c GROUP BY doc_id",
    "question_spans": f"WITH {C2}, {SPANS} SELECT doc_id, head AS start_para, end_para FROM k",
    "question_kinds": f"WITH {C2}, {SPANS} SELECT doc_id, head AS para, kind, end_para, CASE kind WHEN 'short' THEN 3 ELSE 0 END AS space FROM k",
    "compress_blanks": f"WITH {C2}, n AS (SELECT *, lead(text) {W} AS nxt, row_number() {W} AS rn FROM c) SELECT doc_id, para, text, has_img FROM n WHERE rn = 1 OR NOT (text = '' AND coalesce(nxt = '', false))",
    "renumber": f"WITH {C2} {RENUMBERED}",
    "position_ratio": f"WITH {C1} SELECT doc_id, para, round(percent_rank() {W}, 9) AS ratio FROM c",
    "gap_runs": f"WITH {C2}, s AS (SELECT doc_id, para, count(*) OVER (PARTITION BY doc_id) AS total, lag(para) {W} AS prev FROM c WHERE {weights(P.KNOWLEDGE)} > {weights(P.QUESTION)}), r AS (SELECT *, sum(CASE WHEN para - prev > 3 AND total >= 3 THEN 1 ELSE 0 END) {W} AS run FROM s) SELECT doc_id, min(para) AS start_para, max(para) AS end_para, count(*) AS n FROM r GROUP BY doc_id, run, total HAVING count(*) >= 3 OR total < 3",
    "pair_examples": f"""WITH RECURSIVE {C2}, s AS (SELECT doc_id, para, count(*) OVER (PARTITION BY doc_id) AS total, lag(para) {W} AS prev FROM c WHERE {weights(P.KNOWLEDGE)} > {weights(P.QUESTION)}), r AS (SELECT *, sum(CASE WHEN para - prev > 3 AND total >= 3 THEN 1 ELSE 0 END) {W} AS run FROM s), g AS (SELECT doc_id, CAST(min(para) AS INT) AS start_para, CAST(max(para) AS INT) AS end_para FROM r GROUP BY doc_id, run, total HAVING count(*) >= 3 OR total < 3),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_para) AS rn FROM g),
e AS (SELECT doc_id, list(para) AS ex FROM c WHERE regexp_matches(text, '^【例 *[0-9]+】') GROUP BY doc_id),
w AS (SELECT doc_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS INT) AS start_para, CAST(0 AS INT) AS end_para, CAST(NULL AS INT) AS example, CAST([] AS INT[]) AS used FROM (SELECT DISTINCT doc_id FROM n)
  UNION ALL SELECT doc_id, rn, start_para, end_para, example, CASE WHEN example IS NULL THEN used ELSE list_append(used, example) END FROM (
    SELECT n.doc_id, n.rn, n.start_para, n.end_para, w.used, list_min(list_filter(coalesce(e.ex, CAST([] AS INT[])), lambda p: p >= n.end_para AND p <= n.end_para + 20 AND NOT list_contains(w.used, p))) AS example
    FROM w JOIN n ON n.doc_id = w.doc_id AND n.rn = w.rn + 1 LEFT JOIN e ON e.doc_id = n.doc_id))
SELECT doc_id, start_para, end_para, coalesce(example, 0) AS example FROM w WHERE rn > 0""",
    "validate_blocks": boundary_sql(C2) + f", b AS ({BLOCKS}), p AS (SELECT *, lag(end_para) OVER (PARTITION BY doc_id ORDER BY ord) AS prev FROM b) SELECT p.doc_id, count(*) <> 3 AS not_three, bool_or(start_para > end_para) AS reversed, bool_or(start_para < d.first OR end_para > d.last) AS outside, coalesce(bool_or(start_para <= prev), false) AS overlapping FROM p JOIN d2 d ON d.doc_id = p.doc_id GROUP BY p.doc_id",
    "assemble_rows": boundary_sql(C2) + f", b AS ({BLOCKS}) SELECT c.doc_id, CAST(row_number() OVER (PARTITION BY c.doc_id ORDER BY ord, para) AS INT) AS pos, marker, para, text FROM c JOIN b ON c.doc_id = b.doc_id AND para BETWEEN start_para AND end_para",
    "filename": "SELECT o_orderkey, concat(concat_ws('_', concat(CASE WHEN month(o_orderdate) >= 9 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END, '-', CASE WHEN month(o_orderdate) >= 9 THEN year(o_orderdate) + 1 ELSE year(o_orderdate) END, '学年'), nullif(trim(o_orderpriority), ''), nullif(o_orderstatus, 'O')), '_教师版.docx') AS filename FROM orders",
    "answer_delete_ranges": f"WITH {C2}, {ANSWERS}, i AS (SELECT doc_id, para, para - row_number() {W} AS run FROM g WHERE gone) SELECT doc_id, min(para) AS start_para, max(para) AS end_para FROM i GROUP BY doc_id, run",
    "student_rows": f"WITH {C2}, {ANSWERS}, n AS (SELECT *, lead(text) {W} AS nxt, row_number() {W} AS rn FROM g WHERE NOT gone) SELECT doc_id, CAST(row_number() {W} AS INT) AS para, text FROM n WHERE rn = 1 OR NOT (text = '' AND coalesce(nxt = '', false))",
    "answer_space": student_sql(C2),
    "student_version": student_sql("c AS (SELECT doc_id, para, trim(string_agg(CASE WHEN " + red_sql("colour") + " THEN '' ELSE coalesce(text, '') END, '' ORDER BY run), ' ') AS text FROM (" + corpora.RUNS.replace("{handouts}", corpora.HANDOUTS).replace("{lineitem}", "lineitem").replace("{orders}", "orders") + ") GROUP BY doc_id, para)"),
    "class_blocks": boundary_sql(C2) + f", bb AS ({BLOCKS}) SELECT doc_id, ord, CASE marker WHEN {q(P.MARKER_KNOWLEDGE)} THEN {q(P.CLASS_KNOWLEDGE)} WHEN {q(P.MARKER_CONSOLIDATION)} THEN {q(P.CLASS_CONSOLIDATION)} ELSE marker END AS marker, start_para, end_para FROM bb",
    "question_density": CANDIDATES + "SELECT doc_id, para FROM de",
    "practice_boundary": boundary_sql(C2) + f", bb AS ({BLOCKS}), {refine_sql('bb')} SELECT doc_id, para FROM pb",
    "hybrid_classes": HYBRID + " SELECT * FROM y",
    "hybrid_split": HYBRID_BLOCKS,
    "objective_features": FEATURES + " SELECT doc_id, array_to_string(knowledge, '、') AS knowledge, array_to_string(types, '、') AS types, array_to_string(tags, '、') AS tags, questions, examples FROM fe",
    "objectives": OBJECTIVES,
    "example_rows": f"WITH g0 AS ({GROUPS}), {C2} SELECT doc_id, CAST(row_number() {W} AS INT) AS para, text FROM c WHERE NOT EXISTS (SELECT 1 FROM g0 WHERE g0.doc_id = c.doc_id AND sound AND c.para BETWEEN start_para AND end_para)",
    "ideal_rows": f"WITH g0 AS ({GROUPS}), c0 AS (WITH {C2} SELECT doc_id, CAST(row_number() {W} AS INT) AS para, text FROM c WHERE NOT EXISTS (SELECT 1 FROM g0 WHERE g0.doc_id = c.doc_id AND sound AND c.para BETWEEN start_para AND end_para)), c AS (SELECT * FROM c0) {RENUMBERED}",
    "upload_checks": CHECKED + " SELECT * FROM k",
    "upload_errors": CHECKED + " SELECT job_id, arg_min(error, pos) FILTER (error IS NOT NULL) AS error FROM k GROUP BY job_id",
    "upload_inputs": f"WITH {MANIFESTS}, f AS (SELECT job_id, pos, {BASE} AS b, CASE WHEN lower({BASE}) LIKE '%.zip' THEN 'zip' WHEN {IS_DOCX} THEN 'docx' END AS kind FROM m), n AS (SELECT *, count(*) OVER (PARTITION BY job_id, kind) AS n FROM f WHERE kind IS NOT NULL), g AS (SELECT job_id, kind, CASE WHEN kind = 'docx' AND n = 2 THEN 0 ELSE pos END AS key, string_agg(b, ' + ' ORDER BY pos) AS label, CAST(count(*) AS INT) AS n_files FROM n GROUP BY 1, 2, 3) SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY kind DESC, key) AS INT) AS nth, kind, label, n_files FROM g",
    "file_versions": VERSIONS,
    "topic": f"WITH {MANIFESTS} SELECT job_id, pos, {topic_sql('name')} AS topic FROM m",
    "short_text": f"WITH {C1}, t AS (SELECT doc_id, para, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS t FROM c) SELECT doc_id, para, CASE WHEN length(t) > 80 THEN concat(substring(t, 1, 79), '…') ELSE t END AS head FROM t",
    "academic_year": "SELECT o_orderkey, concat(CASE WHEN month(o_orderdate) >= 9 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END, '-', CASE WHEN month(o_orderdate) >= 9 THEN year(o_orderdate) + 1 ELSE year(o_orderdate) END, '学年') AS academic_year FROM orders",
    "is_red": "WITH h AS (SELECT o_orderkey, o_orderkey * 7919 % 16777216 AS v FROM orders) SELECT o_orderkey, lpad(upper(format('{:x}', v)), 6, '0') AS colour, (v // 65536 >= 100 AND v // 256 % 256 <= 70 AND v % 256 <= 70) AS is_red FROM h",
    "template_similarity": "WITH t AS (SELECT label AS category, embedding AS template FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 3), s AS (SELECT vec_id, category, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(template AS DOUBLE[])))), 6) AS similarity FROM embeddings, t) SELECT vec_id, category, similarity FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, category) = 1",
    "auto_split": AUTO,
    "reading_spans": f"WITH {C2}, e AS (SELECT doc_id, para, {rx(P.READING)} AS begins, max(para) OVER (PARTITION BY doc_id) AS last FROM c QUALIFY begins OR {rx(P.READING_ENDS)}), n AS (SELECT *, lead(para) {W} AS nxt FROM e) SELECT doc_id, para AS start_para, CAST(coalesce(nxt - 1, last) AS INT) AS end_para FROM n WHERE begins",
    "image_fix": IMAGES,
    "example_groups": GROUPS,
    "ideal_split": IDEAL,
    "candidates": CANDIDATES + "SELECT * FROM me",
    "candidate_choice": CANDIDATES + "SELECT doc_id, p_para AS practice_para, p_score AS practice_score, p_source AS practice_source, c.para AS consolidation_para, c.score AS consolidation_score, c.source AS consolidation_source FROM ch WHERE p_para IS NOT NULL",
    "candidate_blocks": CANDIDATES + f", k0 AS (SELECT doc_id, first, last, coalesce(p_para, first + CAST(trunc((last - first) * 0.5::DOUBLE) AS INT)) AS p0, c.para AS c0 FROM ch), k1 AS (SELECT *, greatest(first, least(p0, last)) AS p, coalesce(c0, p0 + CAST(trunc((last - p0) * 0.7::DOUBLE) AS INT)) AS c1 FROM k0), k AS (SELECT *, CASE WHEN p < last THEN greatest(p + 1, least(c1, last)) ELSE last END AS c FROM k1) SELECT doc_id, 1 AS ord, {q(P.MARKER_KNOWLEDGE)} AS marker, first AS start_para, CAST(greatest(first, p - 1) AS INT) AS end_para FROM k UNION ALL SELECT doc_id, 2, {q(P.MARKER_DRILL)}, CAST(p AS INT), CAST(greatest(p, c - 1) AS INT) FROM k UNION ALL SELECT doc_id, 3, {q(P.MARKER_CONSOLIDATION)}, CAST(c AS INT), last FROM k",
    "needs_review": CANDIDATES + f", v AS (SELECT doc_id, CASE WHEN p_para IS NULL THEN {q(candidates.NO_PRACTICE)} WHEN c IS NULL THEN {q(candidates.NO_CONSOLIDATION)} WHEN p_score < 80 THEN concat({q(candidates.PRACTICE_UNSURE)}, p_score) WHEN c.score < 80 THEN concat({q(candidates.CONSOLIDATION_UNSURE)}, c.score) WHEN {close_sql('practice_start')} THEN {q(candidates.SEVERAL_PRACTICES)} WHEN {close_sql('consolidation_start')} THEN {q(candidates.SEVERAL_CONSOLIDATIONS)} ELSE {q(candidates.CLEAR)} END AS reason FROM ch) SELECT doc_id, reason <> {q(candidates.CLEAR)} AS wanted, reason FROM v",
    "candidate_report": CANDIDATES + "SELECT doc_id, kind, string_agg(concat('  [', lpad(CAST(score AS VARCHAR), 3, ' '), '] 段落 ', para, ': ', reason, ' | ', text), chr(10) ORDER BY place) AS lines FROM rk WHERE place <= 6 GROUP BY doc_id, kind",
    "para_count": f"WITH {C1} SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id",
    "clean_toc_name": "WITH t AS (SELECT o_orderkey, trim(concat(trim(o_orderpriority), repeat('.', CAST(o_orderkey % 9 AS INT)), ' ', o_custkey)) AS t FROM orders) SELECT o_orderkey, " + name_sql("t") + " AS name FROM t",
    "toc_role": f"WITH {C2}, r AS (SELECT doc_id, para, {role_sql('text')} AS role FROM c) SELECT * FROM r WHERE role IS NOT NULL",
    "toc_entries": f"WITH {C3}, {ENTRIES_SQL} SELECT n7.doc_id, toc_end, para, role, name FROM n7 JOIN ent USING (doc_id)",
    "toc_headings": f"WITH {C2}, {HEADINGS_SQL} SELECT * FROM v2 WHERE role IS NOT NULL",
    "toc_split": contents_sql(C3) + " SELECT * FROM pr",
    "smart_split": f"WITH tt AS ({contents_sql(C3)} SELECT * FROM pr), aa AS ({AUTO.replace(C2, C3)}) SELECT doc_id, 'toc' AS tier, ord, marker, start_para, end_para FROM tt UNION ALL SELECT doc_id, tier, ord, marker, start_para, end_para FROM aa WHERE doc_id NOT IN (SELECT doc_id FROM tt)",
    "smart_blocks": SMART.replace(C2, C3),
    "hybrid_tiers": f"SELECT doc_id, 'hybrid' AS tier, ord, marker, start_para, end_para FROM ({HYBRID_BLOCKS})",
    "refined_blocks": boundary_sql(C2) + f", bb AS ({BLOCKS}), {refine_sql('bb')} {refined_sql('bb', '')}",
    "table_islands": f"WITH {TABLES_SQL} SELECT doc_id, s AS start_para, e AS end_para FROM ti",
    "blocks_widened": boundary_sql(C2) + f", bb AS ({BLOCKS}), {TABLES_SQL} {widened_sql('bb')}",
    "filled_rows": FILLED + "SELECT * FROM fi",
    "filled_trimmed": FILLED + TRIMMED,
    "missing_anchors": FILLED + "SELECT doc_id, ord, marker FROM tb WHERE start_para > 0 AND end_para >= start_para AND NOT EXISTS (SELECT 1 FROM an WHERE an.template = tb.template AND an.marker = tb.marker)",
    "review_sample": REVIEW_SAMPLE,
    "reviewed_blocks": REVIEWED,
    "reply_blocks": REPLY_BLOCKS,
    "objectives_sample": OBJECTIVES_SAMPLE,
    "split_sample": f"WITH {C1} SELECT doc_id, para, concat('[', para, '] ', substring(text, 1, 150), CASE WHEN length(text) > 150 THEN '...' ELSE '' END) AS line FROM c",
    "candidate_mode": CANDIDATE_MODE,
    "version_blocks": VERSION_BLOCKS,
    "migrated_relations": MIGRATED,
    "block_errors": f"""WITH {C2}, {drawn_sql("fb", corpora.FAULTY_BLOCKS)}, ex AS (SELECT doc_id, min(para) AS first, max(para) AS last FROM c GROUP BY doc_id),
p AS (SELECT fb.*, first, last, lag(end_para) OVER (PARTITION BY fb.doc_id ORDER BY ord) AS prev FROM fb LEFT JOIN ex USING (doc_id)),
e AS (SELECT doc_id, 0 AS ord, 0 AS k, concat({q(P.BLOCK_COUNT)}, count(*)) AS error FROM p WHERE first IS NOT NULL GROUP BY doc_id HAVING count(*) <> 3
  UNION ALL SELECT doc_id, ord, 1, concat(marker, ' start > end：', start_para, '>', end_para) FROM p WHERE start_para > end_para AND first IS NOT NULL
  UNION ALL SELECT doc_id, ord, 2, concat(marker, {q(P.BLOCK_OUTSIDE)}, start_para, '-', end_para, {q(P.BLOCK_RANGE)}, first, '-', last) FROM p WHERE start_para < first OR end_para > last
  UNION ALL SELECT doc_id, ord, 3, concat(marker, {q(P.BLOCK_OVER)}, start_para, ', prev_end=', prev) FROM p WHERE start_para <= prev AND first IS NOT NULL
  UNION ALL SELECT DISTINCT doc_id, 0, 0, {q(P.NO_ROWS)} FROM p WHERE first IS NULL)
SELECT d.doc_id, count(error) = 0 AS valid, coalesce(string_agg(error, chr(10) ORDER BY ord, k), '') AS errors FROM (SELECT DISTINCT doc_id FROM p) d LEFT JOIN e ON e.doc_id = d.doc_id GROUP BY d.doc_id""",
    "counters": f"""WITH {C2}, {drawn_sql("ru", corpora.RUNS)}, {ANSWERS}, {SPANS} SELECT doc_id, red_runs, coalesce(answer_rows, 0) AS answer_rows, coalesce(short_questions, 0) AS short_questions, coalesce(blank_questions, 0) AS blank_questions
FROM (SELECT doc_id, count(*) FILTER ({red_sql("colour")}) AS red_runs FROM ru GROUP BY doc_id) LEFT JOIN (SELECT doc_id, count(*) AS answer_rows FROM g WHERE gone GROUP BY doc_id) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) FILTER (kind = 'short') AS short_questions, count(*) FILTER (kind = 'blank') AS blank_questions FROM k GROUP BY doc_id) USING (doc_id)""",
    "group_lines": f"WITH g0 AS ({GROUPS}) SELECT doc_id, string_agg(concat({q(P.GROUP_LINE)}, start_para, '..', end_para), chr(10) ORDER BY start_para) AS summary FROM g0 GROUP BY doc_id",
    "upload_totals": f"WITH {MANIFESTS} SELECT job_id, count(*) AS n_files, count(*) FILTER (lower(name) LIKE '%.zip') AS n_zip, count(*) FILTER (lower(name) LIKE '%.docx') AS n_docx, CAST(sum(size) AS BIGINT) AS n_bytes FROM m GROUP BY job_id",
    "upload_options": f"""{CHECKED}, {drawn_sql("jb", corpora.JOBS)}, fe AS (SELECT job_id, arg_min(error, pos) FILTER (error IS NOT NULL) AS error, count(*) AS n, count(*) FILTER (regexp_matches(lower(name), '\\.(zip|docx)$')) AS usable FROM k GROUP BY job_id)
SELECT jb.job_id, CASE WHEN fe.n IS NULL THEN {q(P.NO_FILES)} WHEN template_type NOT IN ('1v1', 'class') OR split_mode NOT IN ('smart', 'candidate', 'ideal', 'full') OR docx_mode NOT IN ('auto', 'separate') THEN {q(P.BAD_OPTIONS)} WHEN error IS NOT NULL THEN error WHEN usable = 0 THEN {q(P.NO_INPUT)} END AS error FROM jb LEFT JOIN fe USING (job_id)""".replace("\\\\", "\\"),
    "cleaned_text": f"WITH {drawn_sql('mt', corpora.MARKED)} SELECT doc_id, para, trim(regexp_replace(regexp_replace(text, '_x[0-9A-Fa-f]{{4}}_', '', 'g'), '[\\x00-\\x1F]', ' ', 'g')) AS text FROM mt".replace("\\\\", "\\"),
    "log_counters": f"WITH {drawn_sql('lg', corpora.LOGS)} SELECT job_id, " + ", ".join(f"coalesce(TRY_CAST(regexp_extract(log, '{k}=([0-9]+)', 1) AS INT), 0) AS {k.lower()}" for k in ("RED", "DELETED", "BLANKS")) + " FROM lg",
    "cover_cells": COVER_CELLS,
    "cover_rows": COVER_ROWS,
    "full_report": CANDIDATES + f"""{CANDIDATE_BLOCKS}, ln AS (SELECT doc_id, kind, string_agg(concat('  [', lpad(CAST(score AS VARCHAR), 3, ' '), '] 段落 ', para, ': ', reason, ' | ', text), chr(10) ORDER BY place) AS lines FROM rk WHERE place <= 6 GROUP BY doc_id, kind),
bd AS (SELECT kb.*, lag(end_para) OVER (PARTITION BY kb.doc_id ORDER BY ord) AS prev, first, last FROM kb JOIN e0 USING (doc_id)),
er AS (SELECT doc_id, ord, 1 AS k, concat(marker, ' start > end：', start_para, '>', end_para) AS error FROM bd WHERE start_para > end_para UNION ALL SELECT doc_id, ord, 2, concat(marker, {q(P.BLOCK_OUTSIDE)}, start_para, '-', end_para, {q(P.BLOCK_RANGE)}, first, '-', last) FROM bd WHERE start_para < first OR end_para > last UNION ALL SELECT doc_id, ord, 3, concat(marker, {q(P.BLOCK_OVER)}, start_para, ', prev_end=', prev) FROM bd WHERE start_para <= prev),
ee AS (SELECT doc_id, string_agg(concat('  - ', error), chr(10) ORDER BY ord, k) AS errors FROM er GROUP BY doc_id),
bl AS (SELECT doc_id, string_agg(concat('  ', marker, ': ', start_para, '-', end_para), chr(10) ORDER BY ord) AS blocks FROM kb GROUP BY doc_id)
SELECT bl.doc_id, concat_ws(chr(10), {q(candidates.REPORT_CANDIDATES)}, {q(candidates.RULE)}, '即时训练候选', coalesce(lp.lines, '  （无）'), '巩固练习候选', coalesce(lc.lines, '  （无）'), '', {q(candidates.REPORT_CHOICE)}, {q(candidates.RULE)},
  CASE WHEN p_para IS NULL THEN '即时训练开始: 未找到明确候选' ELSE concat('即时训练开始: 段落 ', p_para, '，', mp.reason, '，置信度 ', p_score) END,
  CASE WHEN p_para IS NULL THEN '巩固练习开始: 未找到明确候选' ELSE concat('巩固练习开始: 段落 ', ch.c.para, '，', CASE ch.c.source WHEN 'fallback' THEN CASE ch.c.score WHEN 55 THEN {q(candidates.BY_COUNT)} ELSE {q(candidates.BY_SHARE)} END ELSE mc.reason END, '，置信度 ', ch.c.score) END,
  '', {q(candidates.REPORT_BLOCKS)}, {q(candidates.RULE)}, blocks, CASE WHEN errors IS NULL THEN '合法性: 通过' ELSE concat('合法性: 失败', chr(10), errors) END) AS report
FROM bl JOIN ch USING (doc_id) LEFT JOIN ee USING (doc_id) LEFT JOIN ln lp ON lp.doc_id = bl.doc_id AND lp.kind = 'practice_start' LEFT JOIN ln lc ON lc.doc_id = bl.doc_id AND lc.kind = 'consolidation_start'
LEFT JOIN me mp ON mp.doc_id = bl.doc_id AND mp.kind = 'practice_start' AND mp.para = p_para LEFT JOIN me mc ON mc.doc_id = bl.doc_id AND mc.kind = 'consolidation_start' AND mc.para = ch.c.para""",
}
