"""Block operators against hand-made cases and plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from vellumspark.functions import tables as B
from vellumspark.functions import text as T
from vellumspark.operators import blocks, export

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


def merged(rects, pad):
    """Plain version: the last of the rest takes in all that it meets, until nothing changes."""
    rest, out = [r for r in rects if r[2] > r[0] and r[3] > r[1]], []
    while rest:
        r = rest.pop()
        while True:
            hit = next((q for q in rest if q[0] < r[2] + pad and q[2] > r[0] - pad and q[1] < r[3] + pad and q[3] > r[1] - pad), None)
            if hit is None:
                break
            rest.remove(hit)
            r = (min(r[0], hit[0]), min(r[1], hit[1]), max(r[2], hit[2]), max(r[3], hit[3]))
        out.append(r)
    return out


@pytest.mark.parametrize("pad", [0.0, 6.0])
def test_rects(spark, pad):
    rng = random.Random(7)
    pages = {p: [(x, y, x + rng.randint(-2, 40), y + rng.randint(0, 40)) for x, y in ((rng.randint(0, 300), rng.randint(0, 300)) for _ in range(p * 6))] for p in range(1, 8)}
    rows = [(1, p, n, tuple(map(float, r))) for p, rects in pages.items() for n, r in enumerate(rects)]
    df = spark.createDataFrame(rows, f"doc_id long, page int, ord int, box {BOX}")
    got = sorted((r.page, *r.box) for r in blocks.merge_rects(df, pad, 40).collect())
    assert got == sorted((p, *map(float, r)) for p, rects in pages.items() if len(rects) <= 40 for r in merged(rects, pad))
    assert blocks.merge_rects(df.limit(0), pad).count() == 0


def test_vector_graphics(spark):
    drawn = [(1, 0, 1, (10.0, 10.0, 60.0, 60.0)), (1, 0, 2, (63.0, 10.0, 90.0, 60.0)), (1, 0, 3, (0.0, 0.0, 600.0, 800.0)), (1, 0, 4, (200.0, 200.0, 205.0, 400.0)), (1, 0, 5, (300.0, 300.0, 400.0, 400.0))]
    texts = [(1, 0, 1, (300.0, 300.0, 400.0, 360.0))]
    make = lambda rows: spark.createDataFrame(rows, f"doc_id long, page int, ord int, box {BOX}")
    assert [tuple(r.box) for r in blocks.vector_graphics(make(drawn), make(texts), 480_000.0).collect()] == [(10.0, 10.0, 90.0, 60.0)]


@pytest.mark.parametrize("text, want", [
    ("ฮง", ""), ("11\" กาขคง", "11) กาขคง"), ("7”กาขคง", "7)กาขคง"), ("4) 4 กาขคง", "4) กาขคง"), ("4) 4) กาขคง", "4) กาขคง"), ("3）กาขคง", "3)กาขคง"),
    ("กาขคง\nนา\n\n  กาขค 2", "กาขคง กาขค 2"), ("abc", ""), ("", ""),
])
def test_list_markers(spark, text, want):
    assert one(spark, T.polish_list("t"), t=text) == want


def test_lists_of_a_document(spark):
    rows = [(1, 1, "text", "4) กาขคง"), (1, 2, "text", "จัดทำมาตรฐาน"), (1, 3, "table", ""), (2, 1, "text", " จัดทำมาตรฐาน "), (2, 2, "text", None), (2, 3, "caption", "ก")]
    df = spark.createDataFrame(rows, "doc_id long, ord int, category string, text string")
    assert sorted((r.doc_id, r.ord, r.text) for r in blocks.polish_lists(df).collect()) == [(1, 1, "4) กาขคง"), (1, 3, ""), (2, 1, " จัดทำมาตรฐาน ")]


def test_footers(spark):
    body = "กาขคง" * 6
    rows = [(1, 950.0, "text", "กา หน้า 3"), (2, 10.0, "text", f"{body} หน้า 3"), (3, 10.0, "text", "กา หน้า 3"), (4, 950.0, "text", "4) กา ขคง หน้า 3" + "x" * 80 + " e-mail : a"), (5, 0.0, "text", None), (6, 0.0, "figure", None), (7, 0.0, "text", body)]
    df = spark.createDataFrame(rows, "ord int, y0 double, category string, text string")
    got = {r.ord: r.text for r in blocks.drop_footers(df, 960.0).collect()}
    assert got == {2: body, 4: rows[3][3], 6: None, 7: body}


def test_markers_in_text(spark):
    found = T.markers_in("t", F.array(*map(F.lit, ("4)", "2.1", "12)"))))
    assert one(spark, found, t="1 2 ) a 2 . 1 b ๔)") == ["4)", "2.1", "12)"]
    assert one(spark, found, t="2,1") == ["2.1"] and one(spark, found, t=None) == []


def test_columns(spark):
    fold = lambda rows: sorted(tuple(r) for r in blocks.fold_columns(spark.createDataFrame(rows, "table_id long, ord int, r0 int, c0 int, r1 int, c1 int, text string")).collect())
    same = [(1, 0, 0, 0, 1, 3, "head"), (1, 1, 1, 0, 2, 1, "a"), (1, 2, 1, 1, 2, 2, "ab"), (1, 3, 1, 2, 2, 3, "x"), (1, 4, 2, 0, 3, 1, "b"), (1, 5, 2, 1, 3, 3, "b")]
    assert fold(same) == [(1, 1, 0, 2, 1, "ab"), (1, 1, 1, 2, 2, "x"), (1, 2, 0, 3, 1, "b"), (1, 2, 0, 3, 2, "b")]
    other = [(1, 1, 0, 0, 1, 1, "a"), (1, 2, 0, 1, 1, 2, "b"), (1, 3, 0, 2, 1, 3, "x")]
    assert fold(other) == [(1, 0, 0, 1, 1, "a"), (1, 0, 1, 1, 2, "b"), (1, 0, 2, 1, 3, "x")]


@pytest.mark.parametrize("grid, want", [([["a", "a"], ["b", "b"], ["c", "x"]], True), ([["a", "a"], ["b", "x"], ["c", "y"]], False), ([["a", "a"]], False), ([["a", "ab"], ["b", "b"], ["c", "x"], ["d", "y"], ["e", "z"], ["f", "w"]], True), ([["", ""], ["", ""]], False)])
def test_duplicate_columns(spark, grid, want):
    assert one(spark, B.columns_are_duplicates(F.array(*(F.array(*map(F.lit, r)) for r in grid)))) is want


def test_sizes(spark):
    assert one(spark, B.column_count(F.lit("<table><tr><td>a</td></tr><tr><th COLSPAN='3'>b</th><td>c</td></tr></table>"))) == 4
    assert one(spark, B.column_count(F.lit("no table"))) == 0
    assert one(spark, export.image_width(F.lit(None).cast("double"), 300)) == 4.0 and one(spark, export.image_width(F.lit(300), 300)) == 1.0
    assert one(spark, T.render_scale(F.lit("fast"), F.lit("tha+eng"))) == 7.5 and one(spark, T.render_scale(F.lit(None).cast("string"), F.lit("eng"))) == 10.0
    assert one(spark, T.render_scale(F.lit("fast"), F.lit("th"), override=99.0)) == 20.0
    assert one(spark, T.trim_percent(F.lit(999))) == 25.0 and one(spark, T.trim_percent(F.lit(-5))) == 0.0


def test_better_table(spark):
    def second(a, b, garbled=False, prefer=True):
        q = lambda v: F.struct(*(F.lit(x).alias(k) for k, x in zip(("nrows", "ncols", "fill", "left_fill", "thai", "filled"), v, strict=True)))
        return one(spark, blocks.better_table(q(a), q(b), F.lit(garbled), prefer))

    sparse, full = (13, 3, 0.5, 0.3, 100.0, 19), (23, 3, 0.9, 0.9, 900.0, 62)
    assert second(sparse, full) is True
    assert second(full, sparse) is False
    assert second((23, 3, 0.9, 0.9, 900.0, 62), (24, 3, 0.9, 0.95, 950.0, 65)) is False
    assert second((23, 3, 0.9, 0.9, 900.0, 62), (24, 3, 0.9, 0.95, 950.0, 65), prefer=False) is True
    assert second((13, 3, 0.9, 0.9, 900.0, 39), (23, 3, 0.9, 0.9, 901.0, 69), garbled=True) is True
