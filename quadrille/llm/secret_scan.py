"""Secret scans with an incremental ledger of blobs.

Each text is a blob, named by its SHA-256. The ledger, a Parquet table, holds the spans found in every
blob under every version of the rules; a scan takes only blobs that the ledger lacks under the present
version, appends them, and joins the ledger back to every document with that text. Ids are shuffled, texts
only if something in them may match. All of it is
DataFrame operations: matches are put between marks by the JVM's regular expressions, split, and their
places summed over the pieces of a text, so no text is walked row by row.

Defined results: a null text counts as empty and has no spans; the mark character itself, U+F8FF, is
read as U+FFFD, which no rule matches, so places don't move; equal texts are scanned once and each row
gets the spans; null ids keep their row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint_dir

MARK, STAND_IN = "", "�"
MASK = "[SECRET]"

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A private key from its BEGIN line to the END line of the same label with no other marker between them, or else to the
#: end of the base64 text that follows. Only possessive loops, so that long texts need no stack.
PEM = (
    r"-----BEGIN ([A-Z ]{0,40})PRIVATE KEY-----"
    r"(?:[^-]*+(?:-{1,4}(?!-)[^-]*+)*+-----END \1PRIVATE KEY-----"
    r"|(?:(?:\s|\\[nr])*+(?:Proc-Type|DEK-Info): [^\n\\]*+)*+(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{16,}+={0,2}(?![\w.-]))*+(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{1,15}+={1,2})?+)"
)
#: Kinds in their order: pattern, and the characters that its last group needs. The first three are the base kinds.
RULES = (
    ("assign", ASSIGN, 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("pem", PEM, 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
)
BASE_KINDS = 3
#: What a match of a kind must hold, lower-cased; plain search for it is far cheaper than the patterns.
NEEDED = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "pem": ("private key-----",), "jwt": ("eyj",)}
SPANS = "array<struct<start:int,kind:int,end:int>>"
LEDGER = f"blob_id string, spans {SPANS}, rule_version string"


def rule_version(rules=RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def find_spans(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(blob_id, spans) of distinct blobs (blob_id, text): spans sorted by start, then kind."""
    text = F.col("text")
    marked = [
        F.when(text.rlike(pattern), F.struct(F.lit(k).alias("kind"), F.split(F.regexp_replace(F.translate(text, MARK, STAND_IN), pattern, f"{MARK}$0{MARK}"), MARK, -1).alias("parts")))
        for k, (_, pattern, _, _) in enumerate(rules)
    ]
    kinds = F.filter(F.array(*marked), lambda x: x.isNotNull())
    rows = blobs.select("blob_id", F.explode_outer(kinds).alias("m")).select("blob_id", F.col("m.kind").alias("kind"), F.posexplode_outer("m.parts").alias("at", "part"))
    fits = F.lit(False)
    for k, (_, pattern, group, least) in enumerate(rules):
        fits = F.when(F.col("kind") == k, F.length(F.regexp_extract("part", pattern, group)) >= least).otherwise(fits)
    rows = rows.select("blob_id", "kind", "at", F.length("part").alias("size"), (F.col("at") % 2 == 1).alias("odd"), F.when(F.col("at") % 2 == 1, fits).alias("fits"))
    end = F.sum("size").over(Window.partitionBy("blob_id", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    rows = rows.withColumn("end", end)
    span = F.when(F.col("odd") & F.col("fits"), F.struct((F.col("end") - F.col("size")).alias("start"), "kind", "end"))
    return rows.groupBy("blob_id").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def may_hold(text: Column, rules=RULES) -> Column:
    """Whether a text can have a match: by plain search for what a kind can't do without, by its pattern where nothing is named."""
    low, tests = F.lower(text), []
    for name, pattern, *_ in rules:
        tests += [low.contains(part) for part in NEEDED.get(name, ())] or [text.rlike(pattern)]
    return F.coalesce(reduce(or_, tests), F.lit(False))


class SecretLedger:
    """Findings by blob and rule version, kept under ``path``, a folder that all executors share; a folder within for each version."""

    def __init__(self, spark: SparkSession, path: str, rules=RULES):
        self.spark, self.path, self.rules, self.version = spark, path, rules, rule_version(rules)
        spark.createDataFrame([], LEDGER).write.mode("append").partitionBy("rule_version").parquet(path)

    def findings(self) -> DataFrame:
        """(blob_id, spans) under the present rules; a blob that two writers scanned at once is there once."""
        rows = self.spark.read.schema(LEDGER).parquet(self.path).where(F.col("rule_version") == self.version)
        return rows.dropDuplicates(["blob_id"]).select("blob_id", "spans")

    def _unseen(self, docs: DataFrame) -> tuple[DataFrame, bool]:
        """The blobs without findings, and whether those are all; only ids are shuffled. They are written, so that Spark knows their size."""
        ids = docs.select(blob_id(F.col("text")).alias("blob_id")).distinct()
        known, folder = self.findings().select("blob_id"), f"{self.path}-unseen-{uuid.uuid4().hex}"
        first = known.isEmpty()
        (ids if first else ids.join(known, "blob_id", "left_anti")).write.parquet(folder)
        return self.spark.read.schema("blob_id string").parquet(folder), first

    def update(self, docs: DataFrame) -> None:
        """Scan the blobs of ``docs`` that were not scanned under the present rules.

        Of texts to scan, those that can't have a match are passed over where they lie, and the few others are shuffled, to be
        scanned once. Unseen blobs of a later run find their texts by a semi join, for which Spark broadcasts the ids if they are few.
        """
        unseen, first = self._unseen(docs)
        texts = docs.select(F.col("text")).where(may_hold(F.col("text"), self.rules)).select(blob_id(F.col("text")).alias("blob_id"), "text")
        if not first:
            texts = texts.join(unseen, "blob_id", "left_semi")
        found = find_spans(texts.dropDuplicates(["blob_id"]), self.rules)
        rows = unseen.join(found, "blob_id", "left").select("blob_id", F.lit(self.version).alias("rule_version"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))
        rows.write.mode("append").partitionBy("rule_version").parquet(self.path)

    def scan(self, docs: DataFrame) -> DataFrame:
        """(doc_id, blob_id, spans) of every row of ``docs``."""
        self.update(docs)
        rows = docs.select("doc_id", blob_id(F.col("text")).alias("blob_id"))
        return rows.join(self.findings(), "blob_id").select("doc_id", "blob_id", "spans")

    def redact(self, docs: DataFrame, mask: str = MASK) -> DataFrame:
        """The documents with every span replaced by ``mask``, and n_chars, where it is a column, counted again.

        Documents that can't have a match pass as they are; only the others meet the ledger.
        """
        self.update(docs)
        span = self.findings().select("blob_id", F.explode("spans").alias("span")).select("blob_id", "span.start", "span.end")
        before = F.max("end").over(Window.partitionBy("blob_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
        # What stays of a text: from the end of what is masked so far to the next span that isn't within it.
        stays = span.withColumn("from", F.coalesce(before, F.lit(0))).groupBy(F.col("blob_id").alias("__blob")).agg(
            F.sort_array(F.collect_list(F.when(F.col("start") >= F.col("from"), F.struct("from", F.col("start").alias("to"))))).alias("__stays"), F.max("end").alias("__rest")
        )
        holds, text = may_hold(docs["text"], self.rules), F.col("text")
        rows = docs.where(holds).join(stays, blob_id(docs["text"]) == F.col("__blob"), "left")
        pieces = F.transform("__stays", lambda c: text.substr(c["from"] + 1, c["to"] - c["from"]))
        clean = F.array_join(F.concat(pieces, F.array(text.substr(F.col("__rest") + 1, F.length(text)))), mask)
        masked = F.col("__blob").isNotNull()
        rows = rows.withColumn("text", F.when(masked, clean).otherwise(text))
        if "n_chars" in docs.columns:
            rows = rows.withColumn("n_chars", F.when(masked, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
        return docs.where(~holds).union(rows.select(*[F.col(f"`{c}`") for c in docs.columns]))


def _text_of(spans: Column, rules=RULES) -> Column:
    names = F.array(*[F.lit(name) for name, *_ in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base kinds, all spans as text."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < BASE_KINDS)
    counts = [count(k).alias(f"n_{name}") for k, (name, *_) in enumerate(RULES[:BASE_KINDS])]
    return found.select("doc_id", *counts, F.sha2(_text_of(base).cast("binary"), 256).alias("base_sha256"), _text_of(F.col("spans")).alias("spans"))


def new_ledger(spark: SparkSession) -> SecretLedger:
    """An empty ledger in the shared folder."""
    return SecretLedger(spark, f"{checkpoint_dir(spark)}/secret-ledger-{uuid.uuid4().hex}")


def op9_secret_scans(spark, sf_dir: str) -> DataFrame:
    return digest(new_ledger(spark).scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))
