"""URL filters: a sort-merge range join of canonical keys with nested prefix rules.

A host is reversed by labels (com.example.blog), so a rule on a host covers an interval of keys, and a
rule on a path the interval of paths that start with it. Each url brings the keys of its host's suffixes
that a rule can have, most specific last, and meets only rules of the same key. Within a key, urls and
rules are sorted by path and swept once: a rule enters with the stack of the rules that it nests in, a
url takes the last rule that came before it and the innermost rule of that stack whose prefix it has. A
key with many urls is dealt over several sweeps of ``SWEEP`` urls or four for each of its rules, whichever
is more, and its rules are copied to each, so no sweep grows with a hot host.

Defined results: a null url, or one without ``://``, has an empty host and path and meets no rule; of
the rules that fit, the longest (host and path) wins, of equally long ones the longer host; equal rules
count once, and of two verdicts for one rule block wins; a rule without a host, path or verdict is left
out; equal pages and null ids keep their rows; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SWEEP = 2000
DEFAULT = "allow"
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _reversed(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def _rules(rules: DataFrame) -> DataFrame:
    """key, labels, path, rule, verdict, and the rule's stack: itself and what it nests in, innermost first."""
    rules = rules.dropna(subset=["host", "path", "verdict"]).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    labels = _reversed(F.col("host"))
    rules = rules.select(F.array_join(labels, ".").alias("key"), F.size(labels).alias("labels"), "path", F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("of_host"), F.concat("host", "path").alias("rule"), "verdict", "path").alias("r"))
    prefixes = F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))
    inner = rules.select("key", "path", F.explode(prefixes).alias("prefix"))
    outer = rules.select("key", F.col("path").alias("prefix"), "r")
    stacks = inner.join(outer, ["key", "prefix"]).groupBy("key", "path").agg(F.reverse(F.sort_array(F.collect_list("r"))).alias("stack"))
    return rules.join(stacks, ["key", "path"]).select("key", "labels", "path", "stack")


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, sweep: int = SWEEP) -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict of each page."""
    rules = _rules(rules)
    depth = rules.agg(F.coalesce(F.max("labels"), F.lit(0))).first()[0]
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    labels = F.slice(_reversed(F.col("host")), 1, max(depth, 1))
    keys = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, F.lit(1), n), "."))
    asked = urls.where("host != ''").select("host", "path").distinct().select("host", "path", F.explode(keys).alias("key"))
    sizes = rules.groupBy("key").agg(F.count("*").alias("rules"))
    counts = asked.join(sizes, "key").groupBy("key").agg(F.count("*").alias("urls"), F.max("rules").alias("rules"))
    deals = counts.select("key", F.ceil(F.col("urls") / F.greatest(F.lit(sweep), 4 * F.col("rules"))).cast("int").alias("deals"))
    dealt = asked.join(deals, "key").select("key", F.pmod(F.xxhash64("host", "path"), "deals").cast("int").alias("deal"), "path", "host", F.lit(None).alias("stack"), F.lit(1).alias("turn"))
    copied = rules.join(deals, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), "path", F.lit(None).cast("string").alias("host"), "stack", F.lit(0).alias("turn"))
    swept = Window.partitionBy("key", "deal").orderBy("path", "turn").rowsBetween(Window.unboundedPreceding, 0)
    met = copied.unionByName(dealt).withColumn("stack", F.last("stack", ignorenulls=True).over(swept)).where("turn = 1")
    # The innermost rule of the stack that is still open at this path.
    open_ = F.filter("stack", lambda r: F.col("path").startswith(r["path"]))
    best = met.select("host", "path", F.get(open_, 0).alias("r")).where("r IS NOT NULL").groupBy("host", "path").agg(F.max("r").alias("r"))
    out = urls.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.lit(default)).alias("verdict"))


def op4_url_filters(spark, sf_dir: str) -> DataFrame:
    values = ", ".join(str(r) for r in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS t(host, path, verdict)")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)
