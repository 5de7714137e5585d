"""Sinks: blocks to text, HTML and Word files."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions import text as T
from vellumspark.functions.text import line_html
from vellumspark.operators.layout import document_text
from vellumspark.options import MARGINS, PAGE_SIZES

_TYPES = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
)
_RELS = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
)


def to_html(lines: DataFrame) -> DataFrame:
    """(doc_id, html): pages in order, each line as an element."""
    rows = lines.select("doc_id", F.struct("page", "y0", "x0", "ln", line_html("text").alias("html")).alias("s"))
    body = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["html"]), lambda h: h != ""), "\n")
    return rows.groupBy("doc_id").agg(F.concat(F.lit("<!DOCTYPE html><html><body>\n"), body, F.lit("\n</body></html>")).alias("html"))


def to_txt(lines: DataFrame) -> DataFrame:
    return document_text(lines)


def image_width(pixels: Column, dpi: float, page_size: str = "A4", margins: str = "Normal") -> Column:
    """Inches that an image takes, within the page's margins; 4 where its size is unknown."""
    _, _, left, right = MARGINS.get(margins, MARGINS["Normal"])
    room = PAGE_SIZES.get(page_size, PAGE_SIZES["A4"])[0] - left - right - 0.2
    return F.least(F.coalesce(pixels / max(dpi, 72.0), F.lit(4.0)), F.lit(room))


def blocks_to_txt(blocks: DataFrame, metadata: str = "") -> DataFrame:
    """(doc_id, text) of blocks (doc_id, ord, page, category, text, figure) in order, with a heading where a page begins.

    Tables are named, figures are their number and page; blank blocks leave nothing.
    """
    rule = "\u2500" * 60
    plain = F.when(T.strip_(F.coalesce("text", F.lit(""))) != "", F.col("text")).otherwise("")
    table = F.when(plain != "", F.concat(F.lit("[Table]\n"), plain)).otherwise("")
    figure = F.concat(F.lit("[Figure "), F.coalesce(F.col("figure").cast("string"), F.lit("?")), F.lit(" \u2014 Page "), (F.col("page") + 1).cast("string"), F.lit("]"))
    part = F.when(F.col("category").isin("text", "caption"), plain).when(F.col("category") == "table", table).when(F.col("category") == "figure", figure).otherwise("")
    before = F.lag("page").over(Window.partitionBy("doc_id").orderBy("ord"))
    head = F.concat(F.when(before.isNull(), "").otherwise(f"\n{rule}\n\n"), F.lit("  Page "), (F.col("page") + 1).cast("string"), F.lit(f"\n\n{rule}\n"))
    rows = blocks.select("doc_id", "ord", F.when(before.isNull() | (before != F.col("page")), head).otherwise("").alias("head"), part.alias("part"))
    items = F.array_sort(F.collect_list(F.struct("ord", "head", "part")))
    parts = F.filter(F.flatten(F.transform(items, lambda s: F.array(s["head"], s["part"]))), lambda x: x != "")
    info = f"--- Document Info ---\n{metadata}\n---\n\n\n" if metadata else ""
    return rows.groupBy("doc_id").agg(F.concat(F.lit(info), F.array_join(parts, "\n\n")).alias("text"))


def docx_bytes(paragraphs: list[tuple[int, str]], page_size: str = "A4") -> bytes:
    """A Word file of (page, text) paragraphs, with a break between pages."""
    w, h = (round(x * 1440) for x in PAGE_SIZES.get(page_size, PAGE_SIZES["A4"]))
    body, last = [], None
    for page, text in paragraphs:
        if last is not None and page != last:
            body.append('<w:p><w:r><w:br w:type="page"/></w:r></w:p>')
        body.append(f'<w:p><w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>')
        last = page
    xml = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{"".join(body)}<w:sectPr><w:pgSz w:w="{w}" w:h="{h}"/></w:sectPr></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _TYPES)
        z.writestr("_rels/.rels", _RELS)
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def to_docx(lines: DataFrame, page_size: str = "A4") -> DataFrame:
    """(doc_id, docx binary): one Word file for each document."""

    def write(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["page", "y0", "x0", "ln"])
        return pd.DataFrame({"doc_id": [pdf.doc_id.iloc[0]], "docx": [docx_bytes(list(zip(pdf.page, pdf.text, strict=True)), page_size)]})

    return lines.groupBy("doc_id").applyInPandas(write, "doc_id long, docx binary")
