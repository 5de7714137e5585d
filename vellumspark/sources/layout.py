"""Sources: files and tables to layout relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.functions.geometry import box
from vellumspark.functions.text import sanitize_component


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pdf_files(spark: SparkSession, path: str, largest_mb: int = 200) -> DataFrame:
    """One row for each file, with an error instead of an exception for what is no PDF, empty or too large."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length")
    error = F.when(~F.lower("path").endswith(".pdf"), "not a PDF").when(F.col("length") == 0, "empty file").when(F.col("length") > largest_mb << 20, f"larger than {largest_mb} MB")
    return files.withColumn("error", error)


def lines_of(docs: DataFrame, rows_per_page: int = 40) -> DataFrame:
    """Text lines as blocks: doc_id, ln, page, text and a box, 24 units a row and 7 a character."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "text"))
    row = F.col("ln") % rows_per_page
    return lines.select(
        "doc_id", "ln", F.floor(F.col("ln") / rows_per_page).cast("int").alias("page"), "text",
        F.lit(50).alias("x0"), (row * 24).alias("y0"), (F.lit(50) + 7 * F.least(F.length("text"), F.lit(120))).alias("x1"), (row * 24 + 20).alias("y1"),
    )


def regions_of(events: DataFrame) -> DataFrame:
    """Layout regions: 50 a page, ten pages a document; category by number, box from the ids and the value."""
    size = F.floor(F.abs("value")).cast("bigint")
    x0, y0 = (F.col("user_id") * 37) % 800, (F.col("event_id") * 53) % 900
    box_ = box(*(c.cast("double") for c in (x0, y0, x0 + 20 + size % 200, y0 + 15 + (size * 7) % 150)))
    category = F.element_at(F.array(*map(F.lit, ("text", "table", "figure"))), (F.col("event_id") % 3 + 1).cast("int"))
    return events.select(
        F.floor(F.col("event_id") / 500).cast("bigint").alias("doc_id"), F.floor(F.col("event_id") / 50).cast("bigint").alias("page"), F.col("event_id").alias("ord"),
        category.alias("category"), F.col("event_type").alias("class"), (F.col("event_id") % 97 / 97.0).alias("confidence"), box_.alias("box"),
    )


def corrections(spark: SparkSession, path: str) -> DataFrame:
    """The correction log: JSON lines with a fixed schema; malformed lines are left out."""
    return spark.read.schema(CORRECTION).option("mode", "DROPMALFORMED").json(path)


CORRECTION = "correction_id string, timestamp timestamp, pdf_name string, page int, bbox array<double>, class string, class_id int, action string, source string, image_file string, label_file string"
HISTORY = "entry_id string, original_filename string, created_at string, files map<string,string>, metadata string"


def history(spark: SparkSession, path: str) -> DataFrame:
    """History entries of all users (folders user/entry/info.json), newest first; a file that is no entry is skipped.

    Naive times count as UTC.
    """
    rows = spark.read.schema(HISTORY).option("multiLine", True).option("mode", "DROPMALFORMED").json(f"{path}/*/*/info.json")
    user = F.regexp_extract("_metadata.file_path", r"/([^/]+)/[^/]+/info\.json$", 1).alias("user")
    return rows.select("*", user).where("entry_id is not null").withColumn("created_at", F.to_timestamp("created_at")).orderBy(F.desc("entry_id"))


def history_file(entries: DataFrame, user: str, entry_id: str, fmt: str) -> DataFrame:
    """The path of a user's own file; names are stripped of all but letters, digits, underscore and hyphen first."""
    own = (F.col("user") == sanitize_component(F.lit(user))) & (F.col("entry_id") == sanitize_component(F.lit(entry_id)))
    return entries.where(own).select(F.element_at("files", fmt).alias("path")).where("path is not null")


def last_corrections(log: DataFrame, n: int = 50) -> DataFrame:
    """The last n lines of a correction log, newest first."""
    return log.orderBy(F.desc("timestamp"), F.desc("correction_id")).limit(n)


def html_blocks(pages: DataFrame) -> DataFrame:
    """Headings, paragraphs and list items of HTML pages in document order: page_id, ord, level (0: no heading), text."""
    body = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " ")
    found: Column = F.regexp_extract_all(body, F.lit(r"(?is)<(?:h[1-6]|p|li)\b[^>]*>.*?</(?:h[1-6]|p|li)>"), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("ord", "part"))
    level = F.coalesce(F.nullif(F.regexp_extract("part", r"(?i)^<h([1-6])", 1), F.lit("")).cast("int"), F.lit(0))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("part", "<[^>]+>", " "), r"(?U)\s+", " "), "^ | $", "")
    return rows.select("page_id", "ord", level.alias("level"), text.alias("text")).where("text <> ''")
