"""Layout functions and operators on small fixtures, and every query with SQL against that SQL."""

import zipfile
import io
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vellumspark.functions import geometry as G
from vellumspark.functions import tables as B
from vellumspark.functions import text as T
from vellumspark.operators import export, layout
from vellumspark.plans import catalog
from vellumspark.sources.layout import corrections, history, history_file, last_corrections
from vellumspark.streaming.corrections import correction_stream, retrain_trigger

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, sf, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(catalog.ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda d: sorted(map(str, d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("token, ok", [("2.1", True), ("11)", True), ("0.78", False), ("99.99", False), ("31)", False), ("20.", True), ("x", False)])
def test_markers(spark, token, ok):
    assert one(spark, T.valid_marker("t"), t=token) is ok


def test_text(spark):
    assert one(spark, T.fix_thai_spacing("t"), t="ก ข ค  ง x") == "กขคง x"
    assert one(spark, T.clean_text("t"), t="a​  b \n----\n\n\n\n๑๒\x01") == "a b\n12"
    assert one(spark, T.thai_join(F.array(F.lit("กข"), F.lit(" คง "), F.lit("ab"), F.lit("")))) == "กขคง ab"
    assert one(spark, T.script_runs("t"), t="กข ab ค") == ["กข ", "ab ", "ค"]
    assert one(spark, T.marker_key("t"), t=" 2.3 x") == "S2.3" and one(spark, T.marker_key("t"), t="7) x") == "L7" and one(spark, T.marker_key("t"), t="x") is None
    assert one(spark, T.line_html("t"), t="## a<b") == "<h2>a&lt;b</h2>"
    assert one(spark, T.is_stub("t"), t="2.1 ") is True
    assert one(spark, T.sanitize_filename("t"), t="../../etc/passwd.pdf") == "_.._etc_passwd.pdf".replace("..", ".")
    assert one(spark, T.compose()(F.lit("é"))) == "é"


def test_geometry(spark):
    quad = F.array(*(F.array(F.lit(float(a)), F.lit(float(b))) for a, b in ((3, 4), (10, 5), (9, 12), (2, 11))))
    assert one(spark, G.quad_to_rect(quad)).asDict() == {"x0": 2.0, "y0": 4.0, "x1": 10.0, "y1": 12.0}
    assert one(spark, G.quad_to_rect(F.array().cast("array<array<double>>"))) is None
    a, b = G.box(*map(F.lit, (0.0, 0.0, 10.0, 10.0))), G.box(*map(F.lit, (5.0, 0.0, 10.0, 10.0)))
    assert one(spark, G.overlap(a, b)) == 1.0 and one(spark, G.cover(a, b)) == 0.5
    assert one(spark, G.snapped(F.lit(20.0), 8)) == 16.0


def test_tables(spark):
    grid = one(spark, B.grid_of_html(F.lit("<table><tr><th>a &amp; b</th><th> </th></tr><tr><td> </td></tr><tr><td><b>x</b></td></tr></table>")))
    assert grid == [["a & b", ""], ["x"]]
    assert one(spark, B.html_of(B.grid_of(F.lit("a\tb\nc")))) == "<table><tr><th>a</th><th>b</th></tr><tr><td>c</td><td></td></tr></table>"
    assert one(spark, B.weak(B.quality(B.grid_of(F.lit("a\tb\n\tc"))))) is True
    assert one(spark, B.columns_are_duplicates(B.grid_of(F.lit("a\ta\nb\tbc\nd\te")))) is True


SEGMENT = "doc_id long, page long, text string, conf double, box struct<x0:double,y0:double,x1:double,y1:double>"


def test_lines_are_anchored_at_their_first_segment(spark):
    rows = [(1, 0, "world", 0.9, (60.0, 12.0, 120.0, 32.0)), (1, 0, "Hello", None, (10.0, 10.0, 50.0, 30.0)), (1, 0, "next line", 0.9, (10.0, 60.0, 90.0, 80.0)), (1, 0, "unsure", 0.1, (0.0, 0.0, 1.0, 1.0)), (1, 0, "  ", 0.9, (0.0, 0.0, 1.0, 1.0)), (1, 0, "no box", 0.9, None)]
    got = layout.segments_to_lines(spark.createDataFrame(rows, SEGMENT)).orderBy("line").collect()
    assert [r.text for r in got] == ["Hello world", "next line"] and tuple(got[0].box) == (10.0, 10.0, 120.0, 32.0)


def test_greedy_suppression_leaves_no_overlap(spark, sf):
    import itertools

    kept = catalog._regions(spark, sf)
    out = layout.non_maximum(kept)
    assert out.count() < kept.count() and set(r.ord for r in out.collect()) <= set(r.ord for r in kept.collect())
    for _, rows in itertools.groupby(sorted(out.collect(), key=lambda r: (r.page, r.category)), key=lambda r: (r.page, r.category)):
        for a, b in itertools.combinations(rows, 2):
            w, h = min(a.box.x1, b.box.x1) - max(a.box.x0, b.box.x0), min(a.box.y1, b.box.y1) - max(a.box.y0, b.box.y0)
            area = min((r.box.x1 - r.box.x0) * (r.box.y1 - r.box.y0) for r in (a, b))
            assert w <= 0 or h <= 0 or w * h / area < 0.60
    lines = layout.dedup_near(catalog._lines(spark, sf))
    assert layout.dedup_near(lines).count() == lines.count()


def test_export(spark):
    rows = [(1, 1, 1, "second page", 0, 0, 9, 9), (1, 0, 0, "# Title & more", 0, 0, 9, 9)]
    lines = spark.createDataFrame(rows, "doc_id long, ln int, page int, text string, x0 int, y0 int, x1 int, y1 int")
    data = export.to_docx(lines).first().docx
    xml = zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml").decode()
    assert xml.index("# Title &amp; more") < xml.index('w:type="page"') < xml.index("second page")
    assert "<h1>Title &amp; more</h1>\n<p>second page</p>" in export.to_html(lines).first().html
    assert export.to_txt(lines).first().text == "# Title & more\n\nsecond page"


def test_softwraps_compare_with_the_grown_block(spark):
    rows = [(1, 0, 0, "กข", 0, 0, 9, 20), (1, 1, 0, "คง", 0, 24, 9, 44), (1, 2, 0, "จฉ", 0, 48, 9, 68), (1, 3, 0, "end", 0, 72, 9, 92)]
    lines = spark.createDataFrame(rows, "doc_id long, ln int, page int, text string, x0 int, y0 int, x1 int, y1 int")
    assert [r.text for r in layout.merge_softwraps(lines).collect()] == ["กขคงจฉ", "end"]


def test_logs_history_and_trigger(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    line = '{"correction_id": "%d", "timestamp": "2026-01-01T00:00:00Z", "class": "table", "source": "manual"}'
    (log / "a.json").write_text("\n".join([line % 1, "broken {", line % 2, line % 3]))
    (log / "b.json").write_text("\n".join(line % k for k in range(4, 12)))
    assert corrections(spark, str(log)).count() == 11
    fired: list[int] = []
    retrain_trigger(correction_stream(spark, str(log)), str(tmp_path / "c"), 5, fired.append).awaitTermination()
    assert fired == [5, 10]
    (log / "c.json").write_text("\n".join(line % k for k in range(12, 17)))
    retrain_trigger(correction_stream(spark, str(log)), str(tmp_path / "c"), 5, fired.append).awaitTermination()
    assert fired == [5, 10, 15]  # the count outlives the query
    assert [r.correction_id for r in last_corrections(corrections(spark, str(log)), 2).collect()] == ["9", "8"]
    os.makedirs(tmp_path / "h/user/20260101")
    (tmp_path / "h/user/20260101/info.json").write_text('{"entry_id": "20260101", "created_at": "2026-01-01T00:00:00", "files": {"txt": "x.txt"}}')
    os.makedirs(tmp_path / "h/other/20260101")
    (tmp_path / "h/other/20260101/info.json").write_text('{"entry_id": "20260101", "created_at": "2026-01-02T00:00:00", "files": {"txt": "y.txt"}}')
    entries = history(spark, str(tmp_path / "h"))
    assert {r.user: r.files for r in entries.collect()} == {"user": {"txt": "x.txt"}, "other": {"txt": "y.txt"}}
    assert [r.path for r in history_file(entries, "../user", "2026.0101", "txt").collect()] == ["x.txt"] and history_file(entries, "user", "20260101", "html").count() == 0


def plain_near(rows):
    """The rule in plain loops, its exact stage aside, for the lines (ln, text, x0, y0, x1, y1) of a page."""
    import re
    from difflib import SequenceMatcher

    def mark(t):
        for kind, p in (("S", r"^\s*(\d{1,2}\.\d{1,2})\b"), ("L", r"^\s*(\d{1,2})\s*[.)]")):
            if m := re.match(p, t.strip()):
                return kind + m.group(1)

    def near(a, b):
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        held = len(short) >= 18 and short in long and len(short) / len(long) >= 0.55
        begin = a[:24] == b[:24] and abs(len(a) - len(b)) <= max(12, len(a) // 5)
        return a == b or held or (len(short) >= 16 and (begin or SequenceMatcher(None, a[:80], b[:80]).ratio() >= 0.90))

    def twins(o, b):
        close = abs(b[3] - o[3]) < 48
        w, h = min(o[4], b[4]) - max(o[2], b[2]), min(o[5], b[5]) - max(o[3], b[3])
        over = w > 0 and h > 0 and w * h / max(1e-6, min((r[4] - r[2]) * (r[5] - r[3]) for r in (o, b))) > 0.12
        like = near(*("".join(r[1].split()) for r in (o, b)))
        if mark(b[1]) and mark(b[1]) == mark(o[1]):
            return ("แผนภูมิ" in o[1]) == ("แผนภูมิ" in b[1]) and (like or close)
        return like and (over or close)

    rich = lambda r: len(re.findall("[\u0e00-\u0e7f]", r[1])) + len(r[1].strip())
    out = []
    for b in sorted(rows, key=lambda r: (r[3], r[2], r[0])):
        for i in range(len(out) - 1, max(0, len(out) - 12) - 1, -1):
            if abs(b[3] - out[i][3]) > 64:
                i = -1
                break
            if b[1].strip() and out[i][1].strip() and twins(out[i], b):
                break
        else:
            i = -1
        if i < 0:
            out.append(b)
        elif rich(b) > rich(out[i]):
            out[i] = b
    return {r[0] for r in out}


def test_near_lines_go_by_the_plain_rule(spark, sf):
    same = "abcdefghijklmnopqrstuvwx"
    texts = [
        (same + " one two", 0, 10), (same + " 9876543 yz", 30, 40),  # alike at the beginning
        ("2.1 first words", 100, 110), ("2.1 other text", 140, 150),  # the same marker, near in height
        ("3) first words", 200, 210), ("3) other text", 255, 265),  # the same marker, not near
        ("a line of some length here", 300, 310), ("a line of some length here", 355, 365),  # equal, neither near nor overlapping
        ("another line of some length", 400, 460), ("another line of some length", 450, 510),  # equal and overlapping
        ("4. แผนภูมิ", 600, 610), ("4. text", 620, 630), ("  ", 640, 650), ("  ", 650, 660),
    ]
    rows = [(1, k, 0, t, 0, a, 100, b) for k, (t, a, b) in enumerate(texts)]
    made = spark.createDataFrame(rows, "doc_id long, ln int, page int, text string, x0 int, y0 int, x1 int, y1 int")
    assert {r.ln for r in layout.dedup_near(made).collect()} == plain_near([(r[1], *r[3:]) for r in rows]) == {1, 2, 4, 5, 6, 7, 8, 10, 11, 12, 13}
    pages: dict = {}
    for r in catalog._lines(spark, sf).collect():
        pages.setdefault((r.doc_id, r.page), []).append((r.ln, r.text, r.x0, r.y0, r.x1, r.y1))
    want = {(d, n) for (d, _), page in pages.items() for n in plain_near(page)}
    assert {(r.doc_id, r.ln) for r in catalog.QUERIES["dedup_near"](spark, sf).collect()} == want


def test_predicates_of_recognised_text(spark):
    check = lambda f, t: one(spark, f("t"), t=t)
    assert all(check(T.healthy_latin, t) for t in ("Microsoft Windows", "ESET", "ms sql", "PC", "VMware vSphere"))
    assert not any(check(T.healthy_latin, t) for t in ("", "X", "BCDFGHJKLMNP", "SLBLS"))
    assert all(check(T.plausible_cell, t) for t in ("Microsoft Windows", "Next Generation Firewall", "1,200", "ข้าว", "A1"))
    assert not any(check(T.plausible_cell, t) for t in ("", "----", "กากากา", "ยอมแพ้"))
    assert all(check(T.thai_hallucination, t) for t in ("ยอมแพ้", "สังคมพิสูจน์มักฯ '_", "x!!"))
    assert not check(T.thai_hallucination, "เครื่องคอมพิวเตอร์แม่ข่าย")
    assert check(T.garbled_for_thai, "BCDFGHJKLMNPQR") and check(T.garbled_for_thai, "โสภณเพ็ญ")
    assert not any(check(T.garbled_for_thai, t) for t in ("", "Hello English only", "Microsoft Windows Server", "ชื่อ จำนวน ข้าว 10"))
    assert one(spark, T.usable_thai("t"), t="ชื่อ\tจำนวน\nข้าว\t10") and not one(spark, T.usable_thai("t", 6, 0.25), t="A B C ข้าว")
    assert one(spark, T.refuse_latin("t", F.lit("tha+eng")), t=" BCDFGHJKLMNPQR ") == "" and one(spark, T.refuse_latin("t", F.lit("eng")), t=" BCDFGHJKLMNPQR ") == "BCDFGHJKLMNPQR"


def test_lines_by_the_first_segment_s_height(spark):
    rows = [(1, 0, t, 0.9, (float(x), c - h / 2, x + 9.0, c + h / 2)) for x, (t, c, h) in enumerate((("a", 5.0, 10.0), ("b", 11.0, 40.0), ("c", 19.0, 10.0)))]
    assert [r.text for r in layout.segments_to_lines(spark.createDataFrame(rows, SEGMENT)).orderBy("line").collect()] == ["a b", "c"]


def test_rects(spark):
    assert tuple(one(spark, G.rect_of(F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0, 5.0)))))) == (1.0, 2.0, 3.0, 4.0) and one(spark, G.rect_of(F.array(F.lit(1.0)))) is None
