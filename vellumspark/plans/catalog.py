"""The registered queries over stand-in layout relations, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.functions import geometry as G
from vellumspark.functions import tables as B
from vellumspark.functions import text as T
from vellumspark.operators import blocks, export, layout
from vellumspark.options import FOOTER_CRUMBS, FOOTER_NOISE, LABEL_IDS
from vellumspark.sources.layout import html_blocks, lines_of, regions_of, table

QUERIES: dict = {}
ORACLES: dict = {}

_LINES = """lines AS (SELECT doc_id, ln, ln // 40 AS page, text, 50 AS x0, (ln % 40) * 24 AS y0, 50 + 7 * least(length(text), 120) AS x1, (ln % 40) * 24 + 20 AS y1
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM documents))"""
_REGIONS = """sized AS (SELECT *, CAST(floor(abs(value)) AS BIGINT) AS size FROM events),
    regions AS (SELECT event_id // 500 AS doc_id, event_id // 50 AS page, event_id AS ord, CASE event_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'table' ELSE 'figure' END AS category,
        event_type AS class, (event_id % 97) / 97.0 AS confidence, CAST((user_id * 37) % 800 AS DOUBLE) AS x0, CAST((event_id * 53) % 900 AS DOUBLE) AS y0,
        CAST((user_id * 37) % 800 + 20 + size % 200 AS DOUBLE) AS x1, CAST((event_id * 53) % 900 + 15 + (size * 7) % 150 AS DOUBLE) AS y1 FROM sized)"""
_INTER = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0.0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0.0)"
_AREA = lambda a: f"greatest(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0), 1e-6)"
_WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"  # white space in the sense of Unicode, for an engine whose \s is narrower


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _lines(spark, sf):
    return lines_of(table(spark, sf, "documents"))


def _regions(spark, sf):
    return regions_of(table(spark, sf, "events"))


#: Every fifth line of the Thai stand-in has Thai letters and marks instead of vowels.
_TO_THAI = ("aeiouAEIOU", "กาขคงตัดี่๒")
_THAI = f"thai AS (SELECT * REPLACE (CASE WHEN ln % 5 = 0 THEN translate(text, '{_TO_THAI[0]}', '{_TO_THAI[1]}') ELSE text END AS text) FROM lines)"


def _thai_lines(spark, sf):
    return _lines(spark, sf).withColumn("text", F.when(F.col("ln") % 5 == 0, F.translate("text", *_TO_THAI)).otherwise(F.col("text")))


_flat = lambda df: df.select(*(c for c in df.columns if c != "box"), F.col("box.x0").alias("x0"), F.col("box.y0").alias("y0"), F.col("box.x1").alias("x1"), F.col("box.y1").alias("y1"))


@_query(f"""WITH {_LINES}, {_THAI}, keyed AS (SELECT *, regexp_replace(text, '{_WS}+', '', 'g') AS k, regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') AS s, length(regexp_replace(text, '[^\\x{{0E00}}-\\x{{0E7F}}]', '', 'g')) AS th FROM thai),
    kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, k ORDER BY th + length(s) DESC, y0, x0, ln) AS n FROM keyed)
    SELECT doc_id, CAST(page AS INTEGER) AS page, count(*) AS n_lines, count(*) FILTER (WHERE k <> '') AS n_filled, CAST(sum(length(s)) AS BIGINT) AS n_chars,
        CAST(sum(length(k)) AS BIGINT) AS n_visible, CAST(sum(th) AS BIGINT) AS n_thai, max(x1) AS "right", max(y1) AS bottom FROM kept WHERE n = 1 OR k = '' GROUP BY doc_id, page""")
def page_statistics(spark, sf):
    return layout.page_statistics(layout.dedup_exact(_thai_lines(spark, sf)))


@_query(f"""WITH {_LINES}, {_THAI}, a AS (SELECT doc_id, ln, translate(text, '๐๑๒๓๔๕๖๗๘๙', '0123456789') AS t FROM thai),
    b AS (SELECT doc_id, ln, CASE WHEN regexp_full_match(t, '(?:{_WS}|[_-]){{4,}}') THEN '' ELSE t END AS t FROM a),
    c AS (SELECT doc_id, ln, regexp_replace(regexp_replace(t, '([\\x{{0E00}}-\\x{{0E7F}}]){_WS}+', '\\1' || chr(1), 'g'), chr(1) || '([^\\x{{0E00}}-\\x{{0E7F}}]|$)', ' \\1', 'g') AS t FROM b),
    d AS (SELECT doc_id, ln, list_reduce([replace(t, chr(1), '')] || ['ั', 'ิ', 'ี', 'ึ', 'ื', 'ุ', 'ู', 'ฺ', '็', '่', '้', '๊', '๋', '์', 'ํ', '๎'], lambda x, m: regexp_replace(x, m || '{{2,}}', m, 'g')) AS t FROM c)
    SELECT doc_id, ln, regexp_replace(regexp_replace(replace(replace(t, 'ํา', 'ำ'), 'เเ', 'แ'), '{_WS}+', ' ', 'g'), '^ | $', '', 'g') AS text FROM d""")
def clean_lines(spark, sf):
    return _thai_lines(spark, sf).select("doc_id", "ln", T.clean_text("text").alias("text"))


@_query(f"""WITH c AS (SELECT doc_id, text, length(text) AS n, length(regexp_replace(text, '[^\\x{{FFFD}}]', '', 'g')) AS broken, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS letters,
    length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(text, '[^)]', '', 'g')) AS closing, length(regexp_replace(text, '[^(]', '', 'g')) AS opening FROM documents)
    SELECT doc_id, regexp_replace(text, '{_WS}+', '', 'g') <> '' AND broken <= n * 0.05 AND letters >= n * 0.25 AS plain,
        regexp_replace(text, '{_WS}+', '', 'g') <> '' AND broken <= n * 0.05 AND letters >= n * 0.25 AND letters >= 40 AND letters >= n * 0.55 AND digits <= n * 0.12 AND closing <= opening + 2 AS for_thai FROM c""")
def text_layer_reliable(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.text_layer_reliable("text").alias("plain"), T.text_layer_reliable("text", True).alias("for_thai"))


@_query(f"""WITH {_LINES}, keyed AS (SELECT *, regexp_replace(text, '{_WS}+', '', 'g') AS k FROM lines),
    kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, k ORDER BY length(regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g')) DESC, y0, x0, ln) AS n FROM keyed)
    SELECT doc_id, ln, text FROM kept WHERE n = 1 OR k = ''""")
def dedup_exact(spark, sf):
    return layout.dedup_exact(_lines(spark, sf)).select("doc_id", "ln", "text")


@_query()
def dedup_near(spark, sf):
    return layout.dedup_near(_lines(spark, sf)).select("doc_id", "ln", "text")


@_query("""WITH tokens AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 40) || ')' WHEN 1 THEN (event_id % 25) || '.' || (user_id % 25) WHEN 2 THEN (event_id % 25) || '.' ELSE '0.' || (event_id % 99) END AS token FROM events),
    parts AS (SELECT *, TRY_CAST(regexp_extract(token, '^(\\d{1,2})\\)$', 1) AS INTEGER) AS p, TRY_CAST(regexp_extract(token, '^(\\d{1,2})\\.$', 1) AS INTEGER) AS d,
        TRY_CAST(regexp_extract(token, '^(\\d{1,2})\\.(\\d{1,2})$', 1) AS INTEGER) AS l, TRY_CAST(regexp_extract(token, '^(\\d{1,2})\\.(\\d{1,2})$', 2) AS INTEGER) AS r FROM tokens)
    SELECT event_id, token, coalesce(p BETWEEN 1 AND 30, d BETWEEN 1 AND 20, l BETWEEN 1 AND 20 AND r BETWEEN 1 AND 20, false) AS valid,
        CASE WHEN l IS NOT NULL THEN 'S' || token ELSE 'L' || regexp_extract(token, '^(\\d{1,2})', 1) END AS marker FROM parts""")
def marker_keys(spark, sf):
    e = table(spark, sf, "events")
    token = F.expr("case event_id % 4 when 0 then concat(event_id % 40, ')') when 1 then concat(event_id % 25, '.', user_id % 25) when 2 then concat(event_id % 25, '.') else concat('0.', event_id % 99) end")
    return e.select("event_id", token.alias("token")).select("event_id", "token", T.valid_marker("token").alias("valid"), T.marker_key("token").alias("marker"))


_MARKERS = "m(token) AS (VALUES ('1.'), ('2.1'), ('3)'), ('42'), ('7.'), ('2'))"


@_query(f"""WITH {_LINES}, {_THAI}, {_MARKERS}, wanted AS (SELECT doc_id, token, replace(replace(token, '.', '\\.'), ')', '\\)') AS e FROM documents, m),
    read AS (SELECT doc_id, translate(text, '๐๑๒๓๔๕๖๗๘๙', '0123456789') AS text FROM thai)
    SELECT doc_id, token FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM read l WHERE l.doc_id = w.doc_id AND CASE WHEN w.token LIKE '%)' THEN regexp_matches(l.text, '(^|[^0-9])' || w.e)
        WHEN regexp_full_match(w.token, '[0-9]{{1,2}}\\.[0-9]{{1,2}}') THEN regexp_matches(l.text, '(^|[^0-9])' || w.e || '($|[^0-9])') ELSE contains(l.text, w.token) END)""")
def missing_markers(spark, sf):
    docs = table(spark, sf, "documents")
    wanted = docs.select("doc_id", F.explode(F.array(*map(F.lit, ("1.", "2.1", "3)", "42", "7.", "2")))).alias("token"))
    return layout.missing_markers(wanted, _thai_lines(spark, sf).select("doc_id", "text"))


_HEADED = "CASE ln % 6 WHEN 1 THEN '2.1 ' WHEN 2 THEN '3. ' WHEN 3 THEN '7) แผนภูมิ' WHEN 4 THEN 'ภาคผนวก ' ELSE '' END || text"


@_query(f"""WITH {_LINES}, t AS (SELECT doc_id, ln, regexp_replace({_HEADED}, '^{_WS}+|{_WS}+$', '', 'g') AS s FROM lines)
    SELECT doc_id, ln, s <> '' AND length(s) <= 90 AND regexp_matches(s, '^([0-9]{{1,2}}\\.[0-9]{{1,2}}\\s+\\S|[0-9]{{1,2}}\\.\\s+\\S|[0-9]{{1,2}}\\)\\s*แผนภูมิ|ภาคผนวก\\s|อภิธานศัพท์$)') AS header FROM t""")
def header_lines(spark, sf):
    return _lines(spark, sf).select("doc_id", "ln", T.is_header(F.expr(_HEADED)).alias("header"))


_SPLIT = "split AS (SELECT doc_id, page, ln, CASE WHEN ln % 2 = 1 THEN 520 ELSE x0 END AS x0, CASE WHEN ln % 2 = 1 THEN 900 ELSE least(x1, 400) END AS x1, y0, y1 FROM lines)"


@_query(f"""WITH {_LINES}, {_SPLIT}, sides AS (SELECT *, x0 + 50 < 470 AS lft FROM split),
    flags AS (SELECT *, count(*) FILTER (WHERE lft) OVER p >= 2 AND count(*) FILTER (WHERE NOT lft) OVER p >= 2
        AND min(CASE WHEN NOT lft THEN x0 END) OVER p - max(CASE WHEN lft THEN x0 END) OVER p > 94 AS two FROM sides WINDOW p AS (PARTITION BY doc_id, page)),
    cols AS (SELECT *, CASE WHEN coalesce(two, false) AND NOT lft THEN 1 ELSE 0 END AS col FROM flags)
    SELECT doc_id, CAST(page AS INTEGER) AS page, ln, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY col, y0, x0, ln) AS INTEGER) AS rank FROM cols""")
def reading_order(spark, sf):
    odd = F.col("ln") % 2 == 1
    rows = _lines(spark, sf).withColumns({"x1": F.when(odd, 900).otherwise(F.least("x1", F.lit(400))), "x0": F.when(odd, 520).otherwise(F.col("x0"))})
    return layout.reading_order(rows, 940).select("doc_id", "page", "ln", "rank")


@_query(f"""WITH {_LINES}, {_THAI}, e AS (SELECT *, min(x0) OVER p AS lo, greatest(max(x1) OVER p - min(x0) OVER p, 1e-6) AS width, regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') AS raw FROM thai WINDOW p AS (PARTITION BY doc_id, page)),
    w AS (SELECT *, lag(y1) OVER o AS py1, lag(x1) OVER o AS px1, greatest(lag(y1) OVER o - lag(y0) OVER o, 1e-6) AS h, lag(raw) OVER o AS praw FROM e WHERE raw <> '' WINDOW o AS (PARTITION BY doc_id, page ORDER BY y0, ln)),
    t AS (SELECT *, regexp_matches(praw, '[\\x{{0E00}}-\\x{{0E7F}}]$') AND regexp_matches(raw, '^[\\x{{0E00}}-\\x{{0E7F}}]') AS meet FROM w),
    f AS (SELECT *, CASE WHEN coalesce(((y0 - py1 < 0.85 * h AND (px1 - lo) / width >= 0.8 AND (x0 - lo) / width < 0.35) OR (meet AND NOT regexp_matches(praw, '[.):;ๆ,]$') AND y0 - py1 < 1.45 * h AND (x0 - lo) / width < 0.4))
        AND NOT regexp_matches(raw, '^[0-9]{{1,2}}[.)]'), false) THEN 0 ELSE 1 END AS starts FROM t),
    g AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id, page ORDER BY y0, ln) AS paragraph FROM f)
    SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(paragraph AS BIGINT) AS paragraph, string_agg(CASE WHEN starts = 1 THEN '' WHEN meet THEN '' ELSE ' ' END || raw, '' ORDER BY ln) AS text, count(*) AS n_lines FROM g GROUP BY doc_id, page, paragraph""")
def lines_to_paragraphs(spark, sf):
    return layout.paragraphs(_thai_lines(spark, sf))


@_query(f"""WITH {_LINES}, c AS (SELECT doc_id, ln, CASE ln % 7 WHEN 1 THEN '----' WHEN 2 THEN 'กาข' || left(text, 9) || '!!' WHEN 3 THEN left(text, 7) || '๙' WHEN 4 THEN '12,' || ln WHEN 5 THEN 'กาขคง' || left(text, 12) ELSE left(text, 24) END AS text FROM lines),
    s AS (SELECT *, regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') AS t FROM c),
    n AS (SELECT *, length(regexp_replace(t, '[^\\x{{0E00}}-\\x{{0E7F}}]', '', 'g')) AS th, length(regexp_replace(t, '[^!@#$%^&*_''=<>]', '', 'g')) AS junk, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS latin, regexp_replace(t, '{_WS}+', '', 'g') AS k FROM s)
    SELECT doc_id, ln, th >= 3 AND t <> '' AND th / greatest(length(t), 1) >= 0.15 AS usable,
        regexp_matches(t, '[!_]{{2,}}|[*]{{2,}}|''{{2,}}') OR (th >= 4 AND ((junk >= 2 AND th < 20) OR (junk >= 1 AND th < 12 AND length(t) <= 24))) AS noise FROM n""")
def text_predicates(spark, sf):
    made = F.expr("case ln % 7 when 1 then '----' when 2 then concat('กาข', left(text, 9), '!!') when 3 then concat(left(text, 7), '๙') when 4 then concat('12,', ln) when 5 then concat('กาขคง', left(text, 12)) else left(text, 24) end")
    return _lines(spark, sf).select("doc_id", "ln", made.alias("text")).select("doc_id", "ln", T.usable_thai("text").alias("usable"), T.thai_hallucination("text").alias("noise"))


@_query()
def cell_predicates(spark, sf):
    cells = _lines(spark, sf).select("doc_id", "ln", F.explode(F.slice(F.split("text", " "), 1, 4)).alias("cell"))
    return cells.select("doc_id", "ln", "cell", T.plausible_cell("cell").alias("plausible"), T.garbled_for_thai(F.upper("cell")).alias("garbled"), T.refuse_latin("cell", F.lit("tha+eng")).alias("text"))


@_query(f"""WITH {_REGIONS} SELECT a.doc_id, a.page, a.ord, a.category FROM regions a WHERE a.category <> 'text' OR a.ord % 7 = 0 OR NOT EXISTS (
    SELECT 1 FROM regions b WHERE b.doc_id = a.doc_id AND b.page = a.page AND b.ord % 11 <> 0 AND ((b.category = 'table' AND {_INTER} / {_AREA('a')} > 0.72)
        OR (b.category = 'figure' AND (a.x0 + a.x1) / 2 BETWEEN b.x0 AND b.x1 AND (a.y0 + a.y1) / 2 BETWEEN b.y0 AND b.y1
            AND {_INTER} / {_AREA('a')} > CASE WHEN {_AREA('b')} > 1000000 * 0.45 THEN 0.92 ELSE 0.80 END)))""")
def region_suppress(spark, sf):
    regions = _regions(spark, sf).withColumns({"text": F.when(F.col("ord") % 7 == 0, F.lit(" 2.1 Title")).otherwise(F.col("class")), "filled": F.col("ord") % 11 != 0})
    return layout.suppress_text(regions, 1_000_000).select("doc_id", "page", "ord", "category")


@_query(f"""WITH {_REGIONS} SELECT doc_id, page, ord FROM regions WHERE category <> 'text' UNION ALL
    SELECT a.doc_id, a.page, a.ord FROM regions a WHERE a.category = 'text' AND NOT EXISTS (SELECT 1 FROM regions b
        WHERE b.category <> 'text' AND b.doc_id = a.doc_id AND b.page = a.page AND {_INTER} / least({_AREA('a')}, {_AREA('b')}) > 0.40)""")
def embedded_merge(spark, sf):
    r = _regions(spark, sf)
    return layout.merge_embedded(r.where("category = 'text'"), r.where("category <> 'text'")).select("doc_id", "page", "ord")


@_query()
def region_nms(spark, sf):
    return _flat(layout.non_maximum(_regions(spark, sf)))


_TOP = f"""ranked AS (SELECT *, {_AREA('r')} AS area, CASE WHEN category = 'figure' THEN {_AREA('r')} ELSE (ord % 37) * (ord % 5) + length(class) * (ord % 2) END AS weight FROM regions r WHERE category <> 'text'),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, category ORDER BY weight DESC, ord) AS k, max(area) OVER (PARTITION BY doc_id, page, category) AS largest FROM ranked WHERE category = 'figure' OR weight > 0),
    top AS (SELECT * FROM k WHERE (category = 'figure' AND k <= 2 AND area >= greatest(0.08 * largest, 1.0)) OR (category = 'table' AND k <= 1))"""


def _contents(spark, sf):
    html, text = F.repeat(F.repeat(F.lit("x"), (F.col("ord") % 37).cast("int")), (F.col("ord") % 5).cast("int")), F.when(F.col("ord") % 2 == 1, F.col("class"))
    return _regions(spark, sf).withColumns({"html": html, "text": text})


@_query(f"WITH {_REGIONS}, {_TOP} SELECT doc_id, page, ord, category, area FROM top")
def structure_topk(spark, sf):
    return layout.top_structure(_contents(spark, sf)).select("doc_id", "page", "ord", "category", "area")


@_query(f"""WITH {_REGIONS}, {_TOP}, d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY weight DESC, page, ord) AS n FROM top)
    SELECT doc_id, page, ord FROM regions WHERE category = 'text' UNION ALL SELECT doc_id, page, ord FROM d WHERE n <= 2""")
def structure_prune(spark, sf):
    return layout.prune_structure(_contents(spark, sf)).select("doc_id", "page", "ord")


@_query(f"""WITH {_REGIONS}, near AS (SELECT a.doc_id, a.page, a.ord, b.ord AS body, abs(a.y0 - b.y0) AS gap, row_number() OVER (PARTITION BY a.doc_id, a.page, a.ord ORDER BY abs(a.y0 - b.y0), b.ord) AS k
    FROM regions a JOIN regions b ON a.doc_id = b.doc_id AND a.page = b.page AND a.category = 'table' AND b.category = 'text' AND abs(a.y0 - b.y0) <= 0.1 * 900)
    SELECT doc_id, page, ord, body, gap FROM near WHERE k = 1""")
def nearest_marker(spark, sf):
    r = _regions(spark, sf)
    return layout.nearest_marker(r.where("category = 'table'"), r.where("category = 'text'"), 900.0)


@_query(f"""WITH {_REGIONS} SELECT doc_id, page, ord, CASE WHEN ord % 10 = 0 THEN 1.0 ELSE confidence END AS confidence, CASE WHEN ord % 10 = 0 THEN 'manual' ELSE 'model' END AS source FROM regions""")
def manual_union(spark, sf):
    r = _regions(spark, sf)
    return layout.manual_union(r.where("ord % 10 <> 0"), r.where("ord % 10 = 0")).select("doc_id", "page", "ord", "confidence", "source")


@_query(f"""WITH {_REGIONS} SELECT ord, format('{{:d}} {{:.6f}} {{:.6f}} {{:.6f}} {{:.6f}}', CASE category WHEN 'text' THEN 1 WHEN 'table' THEN 5 ELSE 3 END,
    (x0 + x1) / 2 / 1024, (y0 + y1) / 2 / 1024, (x1 - x0) / 1024, (y1 - y0) / 1024) AS label FROM regions""")
def yolo_labels(spark, sf):
    number = F.when(F.col("category") == "text", LABEL_IDS["plain text"]).when(F.col("category") == "table", LABEL_IDS["table"]).otherwise(LABEL_IDS["figure"])
    return _regions(spark, sf).select("ord", G.label_line(number, F.col("box"), 1024, 1024).alias("label"))


_LOG = "log AS (SELECT event_id // 500 AS doc_id, event_id AS ord, CASE WHEN event_id % 3 = 0 THEN 'manual' ELSE 'model' END AS source FROM events)"


def _log(spark, sf):
    return table(spark, sf, "events").select(F.floor(F.col("event_id") / 500).alias("doc_id"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 3 == 0, "manual").otherwise("model").alias("source"))


@_query(f"WITH {_LOG} SELECT count(*) FILTER (WHERE source = 'manual') AS n_manual, (count(*) FILTER (WHERE source = 'manual') // 5 + 1) * 5 AS next_at FROM log")
def correction_stats(spark, sf):
    return layout.correction_stats(_log(spark, sf), 5)


@_query(f"WITH {_LOG}, m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM log WHERE source = 'manual') SELECT doc_id, ord, CAST(n AS INTEGER) AS n FROM m WHERE n % 5 = 0")
def retrain_points(spark, sf):
    return layout.retrain_points(_log(spark, sf), 5)


@_query("SELECT event_id, ts AS created_at FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def retention(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("ts").alias("created_at"))
    return layout.expired(e, e.agg(F.max("created_at")).scalar(), 7)


@_query("""WITH p AS (SELECT event_id // 50 AS group_id, (event_id * 53) % 900 AS pos FROM events),
    f AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY group_id ORDER BY pos) < 12 THEN 0 ELSE 1 END AS new FROM p),
    c AS (SELECT *, sum(new) OVER (PARTITION BY group_id ORDER BY pos) AS cluster FROM f)
    SELECT group_id, CAST(cluster AS BIGINT) AS cluster, CAST(floor(avg(pos)) AS INTEGER) AS centre, count(*) AS n FROM c GROUP BY group_id, cluster""")
def cluster_positions(spark, sf):
    points = table(spark, sf, "events").select(F.floor(F.col("event_id") / 50).alias("group_id"), ((F.col("event_id") * 53) % 900).alias("pos"))
    return layout.cluster_positions(points, 12)


@_query("SELECT page_id, length(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS n_chars, md5(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS text_md5 FROM pages")
def html_strip(spark, sf):
    text = T.strip_tags("html")
    return table(spark, sf, "pages").select("page_id", F.length(text).alias("n_chars"), F.md5(text.cast("binary")).alias("text_md5"))


@_query()
def html_to_blocks(spark, sf):
    return html_blocks(table(spark, sf, "pages"))


# every second table has Thai cells; a third of its second cells are blank
_CELL = "CASE WHEN l_linenumber % 3 = 0 THEN '' WHEN l_orderkey % 2 = 0 THEN repeat('กา', CAST(l_quantity AS INT)) ELSE l_returnflag || l_linestatus END"


@_query(f"""WITH r AS (SELECT l_orderkey, [CASE WHEN l_orderkey % 2 = 0 THEN 'ขค' ELSE '' END || l_linenumber, {_CELL}, CASE WHEN l_linenumber = 4 THEN '!!' ELSE l_returnflag END] AS row_ FROM lineitem),
    x AS (SELECT *, list_filter(row_, lambda x: x <> '' AND x <> '!!') AS real, list_filter(row_[1:2], lambda x: length(regexp_replace(x, '[^\\x{{0E00}}-\\x{{0E7F}}]', '', 'g')) >= 2) AS lf, length(regexp_replace(row_[1] || row_[2], '[^\\x{{0E00}}-\\x{{0E7F}}]', '', 'g')) AS th, l_orderkey % 2 = 0 AS t FROM r),
    c AS (SELECT l_orderkey, count(*) AS nrows, sum(len(row_)) AS cells, sum(len(real)) AS filled, sum(len(lf)) / (2 * count(*)) AS left_fill, sum(th) * CASE WHEN bool_or(row_[3] = '!!') THEN 0.25 ELSE 1.0 END AS thai FROM x GROUP BY l_orderkey)
    SELECT l_orderkey, CAST(nrows AS INTEGER) AS nrows, 3 AS ncols, CAST(cells AS INTEGER) AS cells, CAST(filled AS INTEGER) AS filled, round(filled / cells, 6) AS fill, round(left_fill, 6) AS left_fill, CAST(thai AS DOUBLE) AS thai,
        thai < 80 OR left_fill < 0.35 OR filled / cells < 0.45 OR (nrows < 18 AND (left_fill < 0.55 OR thai < 200)) AS weak FROM c""")
def table_quality(spark, sf):
    first = F.concat(F.when(F.col("l_orderkey") % 2 == 0, "ขค").otherwise(""), F.col("l_linenumber").cast("string"))
    row = F.concat_ws("\t", first, F.expr(_CELL), F.when(F.col("l_linenumber") == 4, "!!").otherwise(F.col("l_returnflag")))
    plain = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("plain"))
    q = plain.select("l_orderkey", B.quality(B.grid_of(F.col("plain"))).alias("q"))
    return q.select("l_orderkey", "q.nrows", "q.ncols", "q.cells", "q.filled", F.round("q.fill", 6).alias("fill"), F.round("q.left_fill", 6).alias("left_fill"), "q.thai", B.weak(F.col("q")).alias("weak"))


@_query("""WITH c AS (SELECT l_orderkey AS table_id, l_linenumber - 1 AS r0, l_linenumber + CAST(l_quantity AS INTEGER) % 2 AS r1, CAST(l_suppkey % 3 AS INTEGER) AS c0, CAST(l_suppkey % 3 + 1 + l_partkey % 2 AS INTEGER) AS c1, CAST(l_partkey AS VARCHAR) AS text FROM lineitem),
    s AS (SELECT table_id, text, r, unnest(range(c0, c1)) AS c FROM (SELECT *, unnest(range(r0, r1)) AS r FROM c)),
    k AS (SELECT *, row_number() OVER (PARTITION BY table_id, r, c ORDER BY length(text) DESC, text DESC) AS n FROM s)
    SELECT table_id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, text FROM k WHERE n = 1""")
def span_paint(spark, sf):
    cells = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey table_id", "l_linenumber - 1 r0", "l_linenumber + cast(l_quantity as int) % 2 r1", "cast(l_suppkey % 3 as int) c0", "cast(l_suppkey % 3 + 1 + l_partkey % 2 as int) c1", "cast(l_partkey as string) text")
    return layout.paint_spans(cells)


@_query(f"WITH {_LINES} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY ln) AS text FROM lines WHERE regexp_replace(text, '{_WS}+', '', 'g') <> '' GROUP BY doc_id")
def doc_text(spark, sf):
    return layout.document_text(_lines(spark, sf))


@_query()
def html_export(spark, sf):
    return export.to_html(_lines(spark, sf))


@_query()
def script_runs(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(T.script_runs("text")).alias("run", "text"))


@_query("SELECT doc_id, CASE WHEN lang = 'th' THEN 'thai' ELSE 'multilingual' END AS engine, CASE WHEN doc_id % 2 = 0 THEN 'tesseract' WHEN lang = 'th' THEN 'thai' ELSE 'multilingual' END AS asked FROM documents")
def language_route(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.route_engine(F.lit("auto"), "lang").alias("engine"), T.route_engine(F.when(F.col("doc_id") % 2 == 0, "Tesseract").otherwise("auto"), "lang").alias("asked"))


@_query(f"""WITH {_LINES}, p AS (SELECT doc_id, page, sum(length(text)) >= 400 AS reliable FROM lines GROUP BY doc_id, page)
    SELECT doc_id, CAST(page AS INTEGER) AS page, reliable, count(*) FILTER (WHERE reliable) OVER (PARTITION BY doc_id) >= greatest(1, (count(*) OVER (PARTITION BY doc_id) + 1) // 2) AND reliable AS use_layer FROM p""")
def text_layer_vote(spark, sf):
    pages = _lines(spark, sf).groupBy("doc_id", "page").agg((F.sum(F.length("text")) >= 400).alias("reliable"))
    return layout.choose_text_layer(pages)


@_query(f"""WITH {_REGIONS}, s AS (SELECT ord, (x0 - 0) / 1020 AS l, (1020 - x1) / 1020 AS r, round_even(x0 / 8, 0) * 8 AS snapped FROM regions)
    SELECT ord, CASE WHEN l > 0.08 AND r > 0.08 AND abs(l - r) < 0.08 THEN 'CENTER' WHEN r < 0.03 AND l > 0.15 THEN 'RIGHT' ELSE 'LEFT' END AS alignment, snapped FROM s""")
def line_alignment(spark, sf):
    page = G.box(*map(F.lit, (0.0, 0.0, 1020.0, 1000.0)))
    return _regions(spark, sf).select("ord", G.alignment(F.col("box"), page).alias("alignment"), G.snapped(F.col("box.x0"), 8).alias("snapped"))


@_query("""SELECT page_id, CASE WHEN s = '' THEN 'unnamed' ELSE s END AS file_name, regexp_replace(url, '[^A-Za-z0-9_-]', '', 'g') AS component FROM (
    SELECT page_id, url, substr(regexp_replace(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g'), '\\.\\.+', '.', 'g'), '^\\.+', ''), 1, 100) AS s FROM pages)""")
def safe_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.sanitize_filename("url").alias("file_name"), T.sanitize_component("url").alias("component"))


@_query("""WITH w AS (SELECT event_id // 500 AS doc_id, event_id % 20 AS line_num, event_id AS ord, event_type AS text, event_id % 101 - 1 AS conf FROM events)
    SELECT doc_id, line_num, string_agg(text, ' ' ORDER BY ord) AS text, round(avg(conf) / 100, 6) AS conf FROM w WHERE conf >= 0 GROUP BY doc_id, line_num""")
def word_lines(spark, sf):
    words = table(spark, sf, "events").select(F.floor(F.col("event_id") / 500).alias("doc_id"), (F.col("event_id") % 20).alias("line_num"), F.col("event_id").alias("ord"), F.col("event_type").alias("text"), (F.col("event_id") % 101 - 1).alias("conf"))
    return layout.words_to_lines(words).withColumn("conf", F.round("conf", 6))


@_query()
def segments_to_lines(spark, sf):
    r = _regions(spark, sf).select("doc_id", "page", F.col("class").alias("text"), F.col("confidence").alias("conf"), "box")
    return _flat(layout.segments_to_lines(r))


@_query()
def softwrap_merge(spark, sf):
    return layout.merge_softwraps(_lines(spark, sf))


@_query("""WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), ' +'), lambda x: x <> '')) AS w FROM conversations),
    p AS (SELECT a.conv_id, a.turn, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS n FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
    SELECT conv_id, turn, round(CASE WHEN n > i THEN i / (n - i) ELSE 0.0 END, 6) AS jaccard FROM p""")
def turn_similarity(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.token_jaccard("text", "next_text"), 6).alias("jaccard"))


#: Lines that begin with list and section numbers, valid or not.
_MARKED = "CASE ln % 4 WHEN 0 THEN CAST(ln % 37 AS STRING) || ') ' WHEN 1 THEN CAST(ln % 23 AS STRING) || '. ' WHEN 2 THEN CAST(ln % 22 AS STRING) || '.' || CAST(ln % 9 AS STRING) || ' ' ELSE '' END || text"


def _marked(spark, sf):
    return _lines(spark, sf).withColumn("text", F.expr(_MARKED))


@_query(f"""WITH {_LINES}, s AS (SELECT doc_id, ln, string_split_regex(regexp_replace({_MARKED}, '^{_WS}+|{_WS}+$', '', 'g'), '{_WS}+') AS w FROM lines),
    t AS (SELECT doc_id, ln, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM s),
    v AS (SELECT *, row_number() OVER (PARTITION BY doc_id, token ORDER BY ln, pos) AS k FROM t WHERE coalesce(TRY_CAST(regexp_extract(token, '^([0-9]{{1,2}})\\)$', 1) AS INT) BETWEEN 1 AND 30,
        TRY_CAST(regexp_extract(token, '^([0-9]{{1,2}})\\.$', 1) AS INT) BETWEEN 1 AND 20,
        TRY_CAST(regexp_extract(token, '^([0-9]{{1,2}})\\.([0-9]{{1,2}})$', 1) AS INT) BETWEEN 1 AND 20 AND TRY_CAST(regexp_extract(token, '^([0-9]{{1,2}})\\.([0-9]{{1,2}})$', 2) AS INT) BETWEEN 1 AND 20, false))
    SELECT doc_id, string_agg(token, ' ' ORDER BY ln, pos) AS markers FROM v WHERE k = 1 GROUP BY doc_id""")
def section_markers(spark, sf):
    return blocks.section_markers(_marked(spark, sf)).select("doc_id", F.array_join("markers", " ").alias("markers"))


@_query(f"""WITH {_LINES}, {_THAI}, s AS (SELECT doc_id, CAST(page AS INTEGER) AS page, ln, regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') AS t FROM thai),
    p AS (SELECT doc_id, page, sum(length(t)) AS c, sum(length(regexp_replace(t, '[^\\x{{0E00}}-\\x{{0E7F}}]', '', 'g'))) AS th, count(*) FILTER (WHERE t <> '') AS n, page % 2 AS f, max(ln) % 3 AS m, (max(ln) % 7) / 100.0 AS ink FROM s GROUP BY doc_id, page)
    SELECT doc_id, page, c < 300 OR n < 5 OR (f >= 1 AND n < 6) OR (ink > 0.03 AND c < 1200) AS sparse, c < 20 AND n = 0 AND f = 0 AS sparse_in_haste, th >= 120 AND ((n >= 6 AND m = 0) OR n >= 8 OR (n >= 4 AND th >= 400 AND m <= 1)) AS complete FROM p""")
def page_gates(spark, sf):
    rows = _thai_lines(spark, sf)
    stats = layout.page_statistics(rows).join(rows.groupBy("doc_id", "page").agg(F.max("ln").alias("last")), ["doc_id", "page"])
    pages = stats.select("doc_id", "page", "n_chars", "n_thai", F.col("n_filled").alias("n_text"), F.lit(0).alias("n_tables"), (F.col("page") % 2).alias("n_figures"), (F.col("last") % 7 / 100.0).alias("ink"), (F.col("last") % 3).alias("n_missing"))
    haste = blocks.page_gates(pages, speed=True).select("doc_id", "page", F.col("sparse").alias("sparse_in_haste"))
    return blocks.page_gates(pages).join(haste, ["doc_id", "page"]).select("doc_id", "page", "sparse", "sparse_in_haste", "complete")


@_query(f"""WITH {_LINES}, h AS (SELECT doc_id, CAST(page AS INTEGER) AS page, bool_or(regexp_matches({_MARKED}, '(^|{_WS})[23]{_WS}*[.)]') OR contains({_MARKED}, '2.2') OR contains({_MARKED}, '2.3') OR contains({_MARKED}, '3.1')) AS hit FROM lines WHERE ln % 3 <> 0 GROUP BY doc_id, page)
    SELECT doc_id, page, hit, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY hit DESC, page) AS INTEGER) AS rank FROM h""")
def recovery_order(spark, sf):
    return blocks.recovery_order(_marked(spark, sf).where("ln % 3 <> 0"))


@_query(f"WITH {_REGIONS} SELECT doc_id, page, coalesce(greatest(40.0, min(y0) FILTER (WHERE category <> 'text') - 4.0), 495.0) AS ceiling FROM regions WHERE category = 'text' OR page % 3 > 0 GROUP BY doc_id, page")
def list_ceilings(spark, sf):
    return blocks.list_ceilings(_regions(spark, sf).where("category = 'text' or page % 3 > 0"), 900.0)


@_query(f"""WITH {_REGIONS}, r AS (SELECT *, class || CAST(ord % 5 AS VARCHAR) AS text FROM regions), lay AS (SELECT * FROM r WHERE ord % 2 = 0 AND category = 'text'), own AS (SELECT * FROM r WHERE ord % 2 = 1),
    kept AS (SELECT * FROM lay a WHERE NOT EXISTS (SELECT 1 FROM own b WHERE b.category <> 'text' AND b.doc_id = a.doc_id AND b.page = a.page AND {_INTER} / least({_AREA('a')}, {_AREA('b')}) > 0.40)),
    more AS (SELECT * FROM own a WHERE category = 'text' AND NOT EXISTS (SELECT 1 FROM own b WHERE b.category <> 'text' AND b.doc_id = a.doc_id AND b.page = a.page AND {_INTER} / least({_AREA('a')}, {_AREA('b')}) > 0.40)
        AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.doc_id = a.doc_id AND k.page = a.page AND k.text = a.text))
    SELECT doc_id, page, ord, category FROM kept UNION ALL SELECT doc_id, page, ord, category FROM more UNION ALL SELECT doc_id, page, ord, category FROM own WHERE category <> 'text'""")
def hybrid_merge(spark, sf):
    r = _regions(spark, sf).withColumn("text", F.concat("class", (F.col("ord") % 5).cast("string")))
    return blocks.hybrid_merge(r.where("ord % 2 = 0"), r.where("ord % 2 = 1")).select("doc_id", "page", "ord", "category")


@_query()
def vector_graphics(spark, sf):
    r = _regions(spark, sf)
    return _flat(blocks.vector_graphics(r.where("category <> 'text'"), r.where("category = 'text'"), 1_000_000.0))


_CLASSES = "CASE ord % 8 WHEN 0 THEN 'title' WHEN 1 THEN 'plain text' WHEN 2 THEN 'figure' WHEN 3 THEN 'figure_caption' WHEN 4 THEN 'table' WHEN 5 THEN 'table_footnote' WHEN 6 THEN 'isolate_formula' ELSE 'formula_caption' END"


@_query(f"""WITH {_REGIONS} SELECT doc_id, CASE WHEN ord % 8 < 2 THEN 'text_regions' WHEN ord % 8 = 2 THEN 'figures' WHEN ord % 8 = 4 THEN 'tables' WHEN ord % 8 IN (3, 7) THEN 'captions' WHEN ord % 8 = 6 THEN 'formulas' ELSE 'other' END AS route, count(*) AS n
    FROM regions GROUP BY ALL""")
def class_routes(spark, sf):
    return blocks.type_counts(blocks.route_classes(_regions(spark, sf).withColumn("class", F.expr(_CLASSES))), "route")


_FOOTED = "CASE ln % 6 WHEN 0 THEN 'แบบฟอร์มเสนอ ' || text WHEN 1 THEN text || ' หน้า ' || CAST(ln % 90 AS STRING) WHEN 2 THEN repeat('กาขคง', 6) || ' หน้า ๓ ' WHEN 3 THEN 'กาขคง หน้า ๑๒' WHEN 4 THEN '4) กา หน้า 3' ELSE text END"
_CRUMBS = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '{FOOTER_CRUMBS[0]}', ' ', 'g'), '{FOOTER_CRUMBS[1]}', ' ', 'g'), '{FOOTER_CRUMBS[2]}', ' ', 'g'), '{FOOTER_CRUMBS[3]}', ' ', 'g')"
_LETTERS = lambda t: f"length(regexp_replace({t}, '[^\\x{{0E00}}-\\x{{0E7F}}]', '', 'g'))"


@_query(f"""WITH {_LINES}, s AS (SELECT doc_id, ln, y0, {_FOOTED} AS text, regexp_replace({_FOOTED}, '^{_WS}+|{_WS}+$', '', 'g') AS t FROM lines),
    c AS (SELECT *, {_LETTERS('t')} AS th, regexp_matches(t, '{FOOTER_NOISE}') AS noisy, trim(regexp_replace({_CRUMBS}, '{_WS}+', ' ', 'g')) AS cleaned FROM s),
    e AS (SELECT *, cleaned <> '' AND {_LETTERS('cleaned')} >= greatest(12, th // 3) AS enough, y0 > 0.88 * 960 AND th < 24 AND NOT regexp_matches(t, '^([0-9]{{1,2}}\\.[0-9]{{1,2}}\\b|[0-9]{{1,2}}\\s*[.)])') AS foot FROM c)
    SELECT doc_id, ln, CASE WHEN noisy AND enough THEN cleaned ELSE text END AS text FROM e WHERE NOT (t = '' OR (noisy AND (foot OR (NOT enough AND th < 20 AND length(t) < 80))))""")
def footer_crumbs(spark, sf):
    made = _lines(spark, sf).withColumns({"text": F.expr(_FOOTED), "category": F.lit("text")})
    return blocks.drop_footers(made, 960).select("doc_id", "ln", "text")


_ITEMS = "CASE ln % 6 WHEN 0 THEN CAST(ln % 40 AS STRING) || '\" ' || text WHEN 1 THEN '3) 4 ' || text || ' กาขคง' WHEN 2 THEN 'ฮง' WHEN 3 THEN CAST(ln % 30 AS STRING) || ')  ' || CAST(ln % 30 AS STRING) || ') กาขคงก ' || text WHEN 4 THEN 'จัดทำมาตรฐาน กาขคง' ELSE text || ' ' || CAST(ln AS STRING) END"


@_query(f"""WITH {_LINES}, s AS (SELECT doc_id, ln, {_ITEMS} AS text, regexp_replace({_ITEMS}, '^{_WS}+|{_WS}+$', '', 'g') AS t FROM lines),
    a AS (SELECT *, replace(regexp_replace(t, '^([0-9]{{1,2}})\\s*"+', '\\1)'), '11"', '11)') AS q FROM s WHERE {_LETTERS('t')} > 3 OR regexp_matches(t, '[0-9๐-๙]')),
    b AS (SELECT *, regexp_extract(q, '^([0-9]{{1,2}}\\))\\s+', 1) AS m, regexp_replace(q, '^[0-9]{{1,2}}\\)\\s+', '') AS rest FROM a),
    c AS (SELECT *, CASE WHEN m <> '' AND starts_with(rest, m) THEN m || ' ' || ltrim(substr(rest, length(m) + 1)) ELSE q END AS u FROM b),
    d AS (SELECT doc_id, ln, text, t, trim(regexp_replace(regexp_replace(u, '^([0-9]{{1,2}}\\))\\s+[0-9]{{1,2}}\\s+', '\\1 '), '{_WS}+', ' ', 'g')) AS p FROM c),
    e AS (SELECT doc_id, ln, CASE WHEN p <> t THEN p ELSE text END AS text, bool_or(regexp_matches(p, '^0?4\\s*[.)]')) OVER (PARTITION BY doc_id) AS fourth FROM d)
    SELECT doc_id, ln, text FROM e WHERE NOT (fourth AND starts_with(text, 'จัดทำมาตรฐาน'))""")
def list_polish(spark, sf):
    return blocks.polish_lists(_lines(spark, sf).withColumns({"text": F.expr(_ITEMS), "category": F.lit("text")})).select("doc_id", "ln", "text")


# rows of three cells, the first two alike in every second table; a third of the tables begin with a cell over the whole width
_CELLS3 = """SELECT l_orderkey AS table_id, l_linenumber * 3 + c AS ord, l_linenumber - 1 AS r0, l_linenumber AS r1, c AS c0, CASE WHEN l_linenumber = 1 AND l_orderkey % 3 = 0 THEN 3 ELSE c + 1 END AS c1,
    CASE WHEN c = 1 AND l_orderkey % 2 = 0 THEN CAST(l_suppkey AS STRING) || 'x' WHEN c = 2 OR c = 1 THEN 'p' || CAST(l_partkey AS STRING) ELSE CAST(l_suppkey AS STRING) END AS text
    FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL), (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2) k WHERE c = 0 OR NOT (l_linenumber = 1 AND l_orderkey % 3 = 0)"""


@_query(f"""WITH cells AS ({_CELLS3}), p AS (SELECT table_id, r0, max(CASE WHEN c0 <= 0 AND c1 > 0 THEN text END) AS a, max(CASE WHEN c0 <= 1 AND c1 > 1 THEN text END) AS b FROM cells GROUP BY table_id, r0),
    f AS (SELECT table_id, count(*) FILTER (WHERE contains(a, b) OR contains(b, a)) AS same, count(*) AS said, bool_or(r0 = 0 AND (contains(a, b) OR contains(b, a))) AS head FROM p GROUP BY table_id),
    w AS (SELECT table_id, same >= 2 AND (same >= said // 2 OR head) AND (SELECT max(c1) FROM cells c WHERE c.table_id = f.table_id) = 3 AS fold FROM f),
    x AS (SELECT cells.*, fold FROM cells JOIN w USING (table_id))
    SELECT table_id, r0, c0, r1, c1, text FROM x WHERE NOT fold UNION ALL
    SELECT table_id, r0, 0, min(r1), 1, arg_max(text, length(text) * 100 - ord) FROM x WHERE fold AND c1 <= 2 GROUP BY table_id, r0 UNION ALL
    SELECT table_id, r0, 1, r1, 2, text FROM x WHERE fold AND c0 = 2""")
def column_fold(spark, sf):
    one = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_partkey").alias("l_partkey"))
    c = one.select("*", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("c"))
    head = (F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 3 == 0)
    text = F.expr("case when c = 1 and l_orderkey % 2 = 0 then l_suppkey || 'x' when c > 0 then 'p' || l_partkey else string(l_suppkey) end")
    cells = c.where((F.col("c") == 0) | ~head).select(F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber") * 3 + F.col("c")).alias("ord"), (F.col("l_linenumber") - 1).alias("r0"), F.col("l_linenumber").alias("r1"), F.col("c").alias("c0"), F.when(head, 3).otherwise(F.col("c") + 1).alias("c1"), text.alias("text"))
    return blocks.fold_columns(cells)


def _cells_sql(name: str, where: str) -> str:
    return f"""{name}_x AS (SELECT l_orderkey // 8 AS t, [{_THAI_CELL}, {_CELL}, l_returnflag] AS w FROM lineitem WHERE {where}),
    {name} AS (SELECT t, count(*) AS nrows, sum(len(list_filter(w, lambda x: x <> ''))) AS filled, sum(len(list_filter(w, lambda x: x <> ''))) / (3 * count(*)) AS fill,
        sum(len(list_filter(w[1:2], lambda x: {_LETTERS('x')} >= 2))) / (2 * count(*)) AS left_fill, CAST(sum({_LETTERS("array_to_string(w, '')")}) AS DOUBLE) AS thai FROM {name}_x GROUP BY t)"""


_THAI_CELL = "CASE WHEN l_orderkey % 2 = 0 THEN 'ขค' ELSE '' END || CAST(l_linenumber AS STRING)"
_FIRST, _SECOND = "l_linenumber <= 1 + (l_orderkey // 8) % 4", "l_linenumber <= 1 + (l_orderkey // 8) % 7"


@_query(f"""WITH {_cells_sql('a', _FIRST)}, {_cells_sql('b', _SECOND)}, j AS (SELECT a.t, a.nrows AS ra, b.nrows AS rb, a.thai AS ta, b.thai AS tb, a.left_fill AS la, b.left_fill AS lb, a.fill AS fa, b.fill AS fb, a.filled AS na, b.filled AS nb FROM a JOIN b USING (t))
    SELECT t AS table_id, CASE WHEN ra >= 6 AND t % 3 > 0 AND NOT (rb >= floor(ra * 1.25) AND tb > ta * 1.15 AND lb > la) THEN false
        WHEN rb >= 18 AND ra < floor(rb * 0.75) AND (tb >= ta * 0.8 OR lb >= la OR fb >= fa) THEN true
        WHEN ra >= 12 AND NOT (ta < 80 OR la < 0.35 OR fa < 0.45 OR (ra < 18 AND (la < 0.55 OR ta < 200))) AND rb < greatest(8, floor(ra * 0.7)) THEN false
        ELSE (tb, lb, fb, nb, rb) > (ta, la, fa, na, ra) END AS second FROM j""")
def pick_table(spark, sf):
    row = F.array(F.expr(_THAI_CELL), F.expr(_CELL), F.col("l_returnflag"))
    rows = table(spark, sf, "lineitem").withColumn("t", F.floor(F.col("l_orderkey") / 8).cast("bigint"))
    grid = lambda n, most: rows.where(F.col("l_linenumber") <= 1 + F.col("t") % most).groupBy("t").agg(F.collect_list(row).alias(n))
    q = grid("a", 4).join(grid("b", 7), "t").select("t", B.quality(F.col("a")).alias("a"), B.quality(F.col("b")).alias("b"))
    return q.select(F.col("t").alias("table_id"), blocks.better_table(F.col("a"), F.col("b"), F.col("t") % 3 == 0).alias("second"))


@_query(f"""WITH {_REGIONS}, b AS (SELECT *, lag(page) OVER (PARTITION BY doc_id ORDER BY ord) AS before FROM regions),
    p AS (SELECT doc_id, ord, CASE WHEN before IS NULL OR before <> page THEN CASE WHEN before IS NULL THEN '' ELSE chr(10) || repeat('─', 60) || chr(10) || chr(10) END || '  Page ' || (page + 1) || chr(10) || chr(10) || repeat('─', 60) || chr(10) ELSE '' END AS head,
        CASE WHEN category = 'figure' THEN '[Figure ' || ord || ' — Page ' || (page + 1) || ']' WHEN ord % 11 = 0 THEN '' WHEN category = 'table' THEN '[Table]' || chr(10) || class ELSE class END AS part FROM b)
    SELECT doc_id, '--- Document Info ---' || chr(10) || 'made' || chr(10) || '---' || chr(10) || chr(10) || chr(10) || string_agg(x, chr(10) || chr(10) ORDER BY ord, k) AS text
    FROM (SELECT doc_id, ord, 0 AS k, head AS x FROM p UNION ALL SELECT doc_id, ord, 1, part FROM p) WHERE x <> '' GROUP BY doc_id""")
def txt_export(spark, sf):
    made = _regions(spark, sf).withColumns({"text": F.when(F.col("ord") % 11 == 0, " ").otherwise(F.col("class")), "figure": F.col("ord")})
    return export.blocks_to_txt(made, "made")


@_query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN CASE WHEN lang = 'th' THEN 7.5 ELSE 5.0 END WHEN doc_id % 4 = 1 THEN 7.5 ELSE 10.0 END AS scale,
    CASE WHEN doc_id % 4 = 0 THEN CASE WHEN lang = 'th' THEN 6.0 ELSE 5.0 END WHEN doc_id % 4 = 1 THEN 7.5 ELSE 10.0 END AS hurried, CAST(greatest(0, least(doc_id % 60 - 10, 25)) AS DOUBLE) AS trim FROM documents""")
def render_scales(spark, sf):
    quality = F.expr("case doc_id % 4 when 0 then 'fast' when 1 then 'balanced' when 2 then 'accurate' else 'other' end")
    return table(spark, sf, "documents").select("doc_id", T.render_scale(quality, "lang").alias("scale"), T.render_scale(quality, "lang", True).alias("hurried"), T.trim_percent(F.col("doc_id") % 60 - 10).alias("trim"))


@_query("""SELECT l_orderkey, l_linenumber, CAST(greatest(1 + l_linenumber, l_quantity % 5) AS INTEGER) AS n_columns, least(l_partkey / 150.0e0, 8.27e0 - 0.75e0 - 0.75e0 - 0.2e0) AS inches FROM lineitem""")
def export_sizes(spark, sf):
    html = F.expr("""concat('<table><tr><td>a</td><th colspan="', l_linenumber, '">b</th></tr><TR>', repeat('<td class="c">c</td>', cast(l_quantity % 5 as int)), '</TR></table>')""")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", B.column_count(html).alias("n_columns"), export.image_width(F.col("l_partkey"), 150.0, margins="Moderate").alias("inches"))


@_query(f"""WITH {_LINES}, t AS (SELECT doc_id, ln, translate({_MARKED}, '๐๑๒๓๔๕๖๗๘๙', '0123456789') AS t FROM lines), m AS (SELECT * FROM (VALUES (1, '4)'), (2, '1.2'), (3, '12)'), (4, '2.')) v(k, token)),
    h AS (SELECT doc_id, ln, k, token, contains(t, token) AS plain, contains(replace(regexp_replace(t, '{_WS}+', '', 'g'), ',', '.'), token) AS loose FROM t, m)
    SELECT doc_id, ln, string_agg(token, ' ' ORDER BY plain DESC, k) AS markers FROM h WHERE plain OR loose GROUP BY doc_id, ln""")
def markers_in_lines(spark, sf):
    found = F.array_join(T.markers_in("text", F.array(*map(F.lit, ("4)", "1.2", "12)", "2.")))), " ")
    return _marked(spark, sf).select("doc_id", "ln", found.alias("markers")).where("markers <> ''")
