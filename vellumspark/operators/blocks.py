"""Operators over whole blocks: markers, page gates, graphics, merged sources, lists, footers, spans, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions import geometry as G
from vellumspark.functions import tables as B
from vellumspark.functions import text as T
from vellumspark.operators.layout import PAGE, _pairs, paint_spans
from vellumspark.options import FIGURE_CLASSES, ITEM_BODIES, TABLE_CLASSES, TEXT_CLASSES, Options


def section_markers(lines: DataFrame) -> DataFrame:
    """(doc_id, markers): the valid markers among a document's words, each once, in order of first sight.

    Their number is bounded by what is a valid marker. Documents without any have no row.
    """
    words = lines.select("doc_id", "ln", F.posexplode(F.split(T.strip_("text"), T.SPACE)).alias("pos", "token"))
    first = words.where(T.valid_marker("token")).groupBy("doc_id", "token").agg(F.min(F.struct("ln", "pos")).alias("at"))
    return first.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda s: s["token"]).alias("markers"))


def page_gates(pages: DataFrame, thai: bool = False, speed: bool = False) -> DataFrame:
    """pages (n_chars, n_thai, n_text, n_tables, n_figures, ink, n_missing) with `sparse` (worth a second extraction) and
    `complete` (needs no recovery of lists). A null ink, the dark share of the page, decides nothing."""
    if speed:
        sparse = (F.col("n_chars") < 20) & (F.col("n_text") == 0) & (F.col("n_tables") == 0) & (F.col("n_figures") == 0)
    else:
        inky = F.coalesce((F.col("ink") > 0.03) & (F.col("n_chars") < 1200), F.lit(False))
        sparse = (F.col("n_chars") < (800 if thai else 300)) | (F.col("n_text") < 5) | ((F.col("n_figures") >= 1) & (F.col("n_text") < 6)) | inky
    few = ((F.col("n_text") >= 6) & (F.col("n_missing") == 0)) | (F.col("n_text") >= 8) | ((F.col("n_text") >= 4) & (F.col("n_thai") >= 400) & (F.col("n_missing") <= 1))
    return pages.withColumns({"sparse": sparse, "complete": (F.col("n_thai") >= 120) & few})


def recovery_order(blocks: DataFrame, o: Options = Options()) -> DataFrame:
    """(doc_id, page, hit, rank): all pages, those first that name a late section or a chart."""
    hit = F.col("text").rlike(r"(?U)(?:^|\s)[23]\s*[.)]") | F.exists(F.array(*map(F.lit, ("2.2", "2.3", "3.1", o.chart_label))), lambda x: F.col("text").contains(x))
    pages = blocks.groupBy(*PAGE).agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("hit"))
    return pages.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("hit"), "page")))


def list_ceilings(regions: DataFrame, page_height: float) -> DataFrame:
    """(doc_id, page, ceiling): just above the first figure or table, which lists stand over; else 0.55 of the page."""
    top = F.min(F.when(F.col("category").isin("figure", "table"), F.col("box.y0")))
    return regions.groupBy(*PAGE).agg(F.coalesce(F.greatest(F.lit(40.0), top - 4.0), F.lit(page_height * 0.55)).alias("ceiling"))


def hybrid_merge(layer: DataFrame, layout: DataFrame, o: Options = Options()) -> DataFrame:
    """The layout's tables and figures, the text layer's text outside them, and of the layout's own text outside them what
    repeats no text of the layer on that page. Layer text without a box stays, layout text without one goes."""
    outside = G.overlap(F.col("l.box"), F.col("r.box")) > o.embedded_overlap
    holds = F.col("category").isin("table", "figure")
    kept = _pairs(layer.where("category = 'text'"), layout.where(holds), "left_anti", outside)
    own = _pairs(layout.where(F.col("category").isin("text", "caption") & F.col("box").isNotNull()), layout.where(holds), "left_anti", outside)
    said = kept.select(*PAGE, T.norm_key("text").alias("key")).where("key <> ''").distinct()
    own = own.withColumn("key", T.norm_key("text")).join(said, [*PAGE, "key"], "left_anti").select(*layout.columns)
    return kept.unionByName(own).unionByName(layout.where(holds))


def merge_rects(rects: DataFrame, pad: float = 0.0, most: int = 500) -> DataFrame:
    """(doc_id, page, box): unions of the boxes of a page that meet when one is padded.

    The last box starts; all that meet it join it until none does, then the last of the rest starts. Empty boxes go. A
    page with over `most` boxes, a drawing rather than a figure, gives none: so a group is bounded.
    """

    def page(pdf):
        import numpy as np
        import pandas as pd

        rest = np.array([[b["x0"], b["y0"], b["x1"], b["y1"]] for b in pdf.sort_values("ord").box]).reshape(-1, 4)
        found = []
        while len(rest):
            own, rest = rest[-1], rest[:-1]
            while True:
                meets = (rest[:, 0] < own[2] + pad) & (rest[:, 2] > own[0] - pad) & (rest[:, 1] < own[3] + pad) & (rest[:, 3] > own[1] - pad)
                if not meets.any():
                    break
                joined = np.vstack([own[None], rest[meets]])
                own, rest = np.r_[joined[:, :2].min(axis=0), joined[:, 2:].max(axis=0)], rest[~meets]
            found.append(dict(zip(("x0", "y0", "x1", "y1"), own.tolist(), strict=True)))
        return pd.DataFrame({"doc_id": pdf.doc_id.iloc[0], "page": pdf.page.iloc[0], "box": found})

    counted = rects.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*PAGE))).where(F.col("n") <= most)
    full = counted.where((F.col("box.x1") > F.col("box.x0")) & (F.col("box.y1") > F.col("box.y0"))).select(*PAGE, "ord", "box")
    types = dict(full.dtypes)
    return full.groupBy(*PAGE).applyInPandas(page, f"doc_id {types['doc_id']}, page {types['page']}, box {types['box']}")


def vector_graphics(drawings: DataFrame, texts: DataFrame, page_area: float, o: Options = Options()) -> DataFrame:
    """(doc_id, page, box): figures made of drawings: merged, neither tiny nor the page's frame, and not mostly text."""
    side, area = o.smallest_figure_side, G.area(F.col("box"))
    framed = F.when(area <= page_area * 0.6, F.col("box"))  # frames count among a page's drawings, but join none
    merged = merge_rects(drawings.withColumn("box", F.coalesce(framed, G.box(*[F.lit(0.0)] * 4))), o.graphic_pad, o.most_drawings)
    wide = (F.col("box.x1") - F.col("box.x0") >= side * 1.2) & (F.col("box.y1") - F.col("box.y0") >= side * 1.2)
    figures = merged.where(wide & (area >= o.smallest_figure_area) & (area <= page_area * 0.6))
    share = F.coalesce(F.sum(G.intersection(F.col("l.box"), F.col("r.box"))), F.lit(0.0)) / G.area(F.col("l.box"))
    met = _pairs(figures, texts, "left").groupBy("l.doc_id", "l.page", "l.box").agg(share.alias("covered"))
    return met.where("covered <= 0.55").select("doc_id", "page", "box")


def route_classes(regions: DataFrame) -> DataFrame:
    """regions with `route`: the kind of work that their class asks for."""
    c = F.col("class")
    kind = F.when(c.isin(*FIGURE_CLASSES), "figures").when(c.isin(*TABLE_CLASSES), "tables").when(c.isin(*TEXT_CLASSES), "text_regions")
    return regions.withColumn("route", kind.when(c.contains("caption"), "captions").when(c.contains("formula"), "formulas").otherwise("other"))


def type_counts(regions: DataFrame, by: str = "category") -> DataFrame:
    return regions.groupBy("doc_id", by).agg(F.count(F.lit(1)).alias("n"))


def drop_footers(blocks: DataFrame, page_height: float) -> DataFrame:
    """Text without the crumbs of forms and footers; short ones at the page's foot, or all crumb, go. Blank text goes, tables
    and figures stay."""
    t = T.strip_(F.coalesce("text", F.lit("")))
    thai, noisy = T.thai_count(t), T.footer_noise(t)
    cleaned = T.scrub_footer(t)
    foot = (F.col("y0") > 0.88 * page_height) & (thai < 24) & T.marker_key(t).isNull()
    enough = (cleaned != "") & (T.thai_count(cleaned) >= F.greatest(F.lit(12), F.floor(thai / 3)))
    is_text = F.col("category").isin("text", "caption")
    goes = is_text & ((t == "") | (noisy & (foot | (~enough & (thai < 20) & (F.length(t) < 80)))))
    return blocks.where(~goes).withColumn("text", F.when(is_text & noisy & enough, cleaned).otherwise(F.col("text")))


def polish_lists(blocks: DataFrame) -> DataFrame:
    """Text with the list markers put right; blank text and stray glyphs go. Where a document has an item 4, bodies that
    begin like it without a marker go too. Tables and figures stay."""
    is_text = F.col("category").isin("text", "caption")
    t = T.strip_(F.coalesce("text", F.lit("")))
    new = T.polish_list(t)
    polished = blocks.where(~is_text | (new != "")).withColumn("text", F.when(is_text & (new != t), new).otherwise(F.col("text")))
    fourth = F.coalesce(F.bool_or(is_text & F.col("text").rlike(r"(?U)^\s*[0๐]?[4๔]\s*[.)]")).over(Window.partitionBy("doc_id")), F.lit(False))
    body = is_text & ~F.col("text").rlike(r"(?U)^\s*\d{1,2}\s*[.)]") & F.exists(F.array(*map(F.lit, ITEM_BODIES)), lambda p: T.strip_("text").startswith(p))
    return polished.withColumn("goes", fourth & body).where(~F.col("goes")).drop("goes")


def fold_columns(cells: DataFrame) -> DataFrame:
    """Cells (table_id, ord, r0, c0, r1, c1, text; half-open) of tables of three columns whose first two are alike, to two
    columns; other tables stay. Of the left cells that begin in one row the first stays, with the longest text of them (ties:
    the first); a cell over all three columns goes."""
    width = cells.groupBy("table_id").agg(F.max("c1").alias("w"))
    grid = paint_spans(cells).groupBy("table_id", "r").agg(F.map_from_entries(F.collect_list(F.struct("c", "text"))).alias("m"))
    row = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda c: F.coalesce(F.try_element_at("m", c), F.lit("")))
    grid = grid.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", row.alias("x")))), lambda s: s["x"]).alias("g"))
    alike = grid.join(width, "table_id").select("table_id", ((F.col("w") == 3) & B.columns_are_duplicates(F.col("g"))).alias("fold"))
    rows = cells.join(alike, "table_id")
    left, right = (F.col("c1") <= 2) & (F.col("c0") <= 1), F.col("c0") >= 1
    best = F.min(F.struct(-F.length("text"), "ord", "text"))
    lefts = rows.where(F.col("fold") & left).groupBy("table_id", "r0").agg(F.min_by("r1", "ord").alias("r1"), best.alias("b"))
    lefts = lefts.select("table_id", "r0", F.lit(0).alias("c0"), "r1", F.lit(1).alias("c1"), "b.text")
    rights = rows.where(F.col("fold") & ~left & right).select("table_id", "r0", F.when(F.col("c0") >= 2, 1).otherwise(0).alias("c0"), "r1", F.lit(2).alias("c1"), "text")
    return rows.where(~F.col("fold")).select(*lefts.columns).unionByName(lefts).unionByName(rights)


def better_table(a: Column, b: Column, garbled_a: Column, prefer_first: bool = True) -> Column:
    """Whether the second of two tables, given their `quality`, is the better reading. By `prefer_first` the first stays
    unless the second is clearly richer; a second one with ruled rows wins over a short first; a strong first over a weak
    second; else the one with more Thai, a fuller left side, more filled cells and rows."""
    richer = (b["nrows"] >= F.floor(a["nrows"] * 1.25)) & (b["thai"] > a["thai"] * 1.15) & (b["left_fill"] > a["left_fill"])
    stays = F.lit(prefer_first) & (a["nrows"] >= 6) & (a["ncols"] >= 2) & ~garbled_a & ~richer
    as_full = (b["thai"] >= a["thai"] * 0.8) | (b["left_fill"] >= a["left_fill"]) | (b["fill"] >= a["fill"])
    ruled = (b["nrows"] >= 18) & (b["ncols"] >= 3) & (a["nrows"] < F.floor(b["nrows"] * 0.75)) & as_full
    shorter = (b["nrows"] < F.greatest(F.lit(8), F.floor(a["nrows"] * 0.7))) | ((a["ncols"] >= 3) & (b["ncols"] < 3))
    strong = (a["nrows"] >= 12) & (a["ncols"] >= 2) & ~B.weak(a) & shorter
    key = lambda q: F.struct(*(q[k].alias(k) for k in ("thai", "left_fill", "fill", "filled", "nrows")))
    return F.when(stays, False).when(ruled, True).when(strong, False).otherwise(key(b) > key(a))
