"""Secret scan: fixed patterns, and weak candidates that complementary parts support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.llm.common import fresh

# The kinds with their patterns, in the order in which they are listed.
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
    "ident": r"""(?i)(?:client_?id|access_?key_?id|account_?id|username|user_?id|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}""",
    "endpoint": r"""(?:https?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|rediss?|amqps?)://[A-Za-z0-9_.:@/?&=%+-]{4,}""",
    "candidate": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}",
}
BASE = ("assign", "access", "hex")
#: Code points between two parts that count as one scope.
SCOPE = 240


def _matches(text: Column, kind: str) -> Column:
    """array<struct<kind, i, gap, len, keep>>: each match with what lies between it and the one before.

    Between matches of one pattern lies what split() leaves, so lengths alone give positions, in code points. A row
    without a match costs one search. {12,} and {32,} match what longer-than tests on maximal runs would leave.
    """
    pattern = PATTERNS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    good = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else whole
    good = F.transform(good, lambda g: F.length(g) >= 8 if kind == "assign" else F.lit(True))
    if kind == "candidate":  # letters of both cases and a digit
        good = F.transform(whole, lambda g: g.rlike("[A-Z]") & g.rlike("[a-z]") & g.rlike("[0-9]"))
    found = F.transform(
        F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("found"), good.alias("good")),
        lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(z["gap"]).alias("gap"), F.length(z["found"]).alias("len"), z["good"].alias("good")),
    )
    found = F.filter(found, lambda m: m["len"].isNotNull())
    none = F.lit(None).cast("array<struct<kind:string,i:int,gap:int,len:int,good:boolean>>")
    return F.coalesce(F.when(text.rlike(pattern), found).otherwise(none), F.array().cast("array<struct<kind:string,i:int,gap:int,len:int,good:boolean>>"))


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row for each row of docs: key, spans array<struct<start, kind_no, end, kind>> by start and kind.

    Base kinds (assign, access, hex) are always reported. Three weak kinds are reported only where complementary parts
    stand within `scope` code points: `candidate` (a long token of mixed letters and digits that no base span covers)
    beside an identifier or endpoint; `ident` and `endpoint` beside a secret (candidate, assign or hex). Access
    identifiers count as identifiers. Each part looks at the nearest part before and behind it of each role, so the
    interval join is a sweep by position: parts are sorted once, no pairs are made, and nothing is capped.

    Null or empty text: no spans. Rows with equal or null keys stay rows of their own. Extra columns are ignored.
    """
    k, t, rid = fresh(docs.limit(0), "key_", "text_", "rid_")
    t_ = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias(k), t_.alias(t)).select(k, F.monotonically_increasing_id().alias(rid), F.concat(*(_matches(F.col(t), kind) for kind in PATTERNS)).alias("parts_"))
    parts = rows.select(k, rid, F.explode_outer("parts_").alias("m")).select(k, rid, "m.*")

    in_order = Window.partitionBy(rid, "kind").orderBy("i")
    parts = parts.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(in_order)).withColumn("start", F.col("end") - F.col("len"))
    parts = parts.withColumn("kind", F.when(F.col("good"), F.col("kind")))  # a failing match keeps its row, but plays no role
    number = F.coalesce(*(F.when(F.col("kind") == kind, F.lit(n)) for n, kind in enumerate(PATTERNS)))
    parts = parts.withColumn("kind_no", number)

    base, secret, side = F.col("kind").isin(*BASE), F.col("kind").isin("assign", "hex", "candidate"), F.col("kind").isin("access", "ident", "endpoint")
    by_start = Window.partitionBy(rid).orderBy("start", "kind_no")
    # what stands behind is what stands before in falling order: a frame that ends at the last row is read anew for each row
    from_end = Window.partitionBy(rid).orderBy(F.desc("start"), F.desc("kind_no"))
    before, behind = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (by_start, from_end))
    last_end = lambda c: F.max(F.when(c, F.col("end"))).over(before)
    next_start = lambda c: F.min(F.when(c, F.col("start"))).over(behind)
    near = lambda c: F.coalesce(F.col("start") - last_end(c) <= scope, F.lit(False)) | F.coalesce(next_start(c) - F.col("end") <= scope, F.lit(False))
    free = F.coalesce(last_end(base) <= F.col("start"), F.lit(True)) & F.coalesce(next_start(base) >= F.col("end"), F.lit(True))
    keep = base | (F.when(F.col("kind") == "candidate", near(side) & free).otherwise(near(secret)) & ~base)
    kept = parts.withColumn("keep", F.coalesce(keep, F.lit(False)))
    span = F.when(F.col("keep"), F.struct("start", "kind_no", "end", "kind"))
    return kept.groupBy(rid, k).agg(F.array_sort(F.collect_list(span)).alias("spans")).select(F.col(k).alias(key), "spans")


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id with counts of the base kinds, the checksum of the base spans and the list of all spans."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, line), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in BASE]
    return scan_secrets(docs).select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
