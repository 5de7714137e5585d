"""Table expressions: grids of array<array<string>>, tab text, HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumspark.functions.text import escape_html, strip_, strip_tags, thai_count, thai_hallucination


def grid_of(plain: Column) -> Column:
    """Tab text to rows of trimmed cells; blank lines go."""
    lines = F.filter(F.split(plain, "\n"), lambda t: strip_(t) != "")
    return F.transform(lines, lambda t: F.transform(F.split(t, "\t"), strip_))


def plain_of(grid: Column) -> Column:
    return F.array_join(F.transform(grid, lambda r: F.array_join(r, "\t")), "\n")


def html_of(grid: Column, header: bool = True) -> Column:
    """Rows padded to the widest one; the first holds header cells."""
    width = F.greatest(F.array_max(F.transform(grid, F.size)), F.lit(0))
    cells = lambda r, tag: F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), lambda c: F.concat(F.lit(f"<{tag}>"), escape_html(c), F.lit(f"</{tag}>"))), "")
    row = lambda r, i: F.concat(F.lit("<tr>"), F.when((i == 0) & F.lit(header), cells(r, "th")).otherwise(cells(r, "td")), F.lit("</tr>"))
    return F.concat(F.lit("<table>"), F.array_join(F.transform(grid, row), ""), F.lit("</table>"))


def grid_of_html(html: Column) -> Column:
    """Rows that have a non-blank cell; tags inside cells go, the five basic entities are read."""
    def read(c: Column) -> Column:
        t = strip_(strip_tags(c, ""))
        for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
            t = F.replace(t, F.lit(a), F.lit(b))
        return t

    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    rows = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), read))
    return F.filter(rows, lambda r: F.exists(r, lambda c: c != ""))


def quality(grid: Column) -> Column:
    """struct<nrows, ncols, cells, filled, fill, left_fill, thai> from the grid itself.

    Cells of made-up noise are not filled, left cells need two Thai characters, and noise counts a quarter of its Thai.
    """
    cells = F.flatten(grid)
    left = F.flatten(F.transform(grid, lambda r: F.slice(r, 1, 2)))
    real = lambda c: (c != "") & ~thai_hallucination(c)
    share = lambda a, ok: F.size(F.filter(a, ok)) / F.greatest(F.size(a), F.lit(1))
    plain = F.array_join(cells, " ")
    thai = thai_count(plain) * F.when(thai_hallucination(plain), 0.25).otherwise(1.0)
    return F.struct(
        F.size(grid).alias("nrows"), F.coalesce(F.array_max(F.transform(grid, F.size)), F.lit(0)).alias("ncols"), F.size(cells).alias("cells"),
        F.size(F.filter(cells, real)).alias("filled"), share(cells, real).alias("fill"), share(left, lambda c: real(c) & (thai_count(c) >= 2)).alias("left_fill"), thai.alias("thai"),
    )


def weak(q: Column) -> Column:
    return (q["thai"] < 80) | (q["left_fill"] < 0.35) | (q["fill"] < 0.45) | ((q["ncols"] >= 3) & (q["nrows"] < 18) & ((q["left_fill"] < 0.55) | (q["thai"] < 200)))


def columns_are_duplicates(grid: Column) -> Column:
    """Whether the first two columns say the same: in two rows at least, and in half of those where either says something or
    in the first row. Cells say the same if they are equal or one holds the other."""
    pairs = F.transform(F.filter(grid, lambda r: F.size(r) >= 2), lambda r: F.struct(strip_(r[0]).alias("a"), strip_(r[1]).alias("b")))
    alike = lambda p: (p["a"] == p["b"]) | ((p["a"] != "") & (p["b"] != "") & (p["a"].contains(p["b"]) | p["b"].contains(p["a"])))
    said = F.filter(pairs, lambda p: (p["a"] != "") | (p["b"] != ""))
    same, head = F.size(F.filter(said, alike)), F.get(pairs, 0)
    return (same >= 2) & ((same >= F.floor(F.size(said) * 0.5)) | F.coalesce((head["a"] != "") & alike(head), F.lit(False)))


def column_count(html: Column) -> Column:
    """The most columns of a row, spans counted; 0 without rows."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    span = lambda tag: F.coalesce(F.nullif(F.regexp_extract(tag, r"(?i)\bcolspan\s*=\s*[\"']?(\d+)", 1), F.lit("")).cast("int"), F.lit(1))
    width = lambda r: F.aggregate(F.regexp_extract_all(r, F.lit(r"(?i)<t[dh]\b[^>]*>"), F.lit(0)), F.lit(0), lambda acc, tag: acc + span(tag))
    return F.coalesce(F.array_max(F.transform(rows, width)), F.lit(0))
