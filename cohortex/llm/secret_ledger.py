"""Secret scans over an incremental blob ledger, in DataFrame functions only.

A blob is the SHA-256 of a text. The ledger is a Parquet table of
(blob, rule, rule_version, spans): one row for every pair of a blob and a
rule version that was scanned, also when nothing was found. A scan
content-addresses every version of every path, drops the pairs that the
ledger has, scans one copy of each remaining blob, appends the findings,
and joins the ledger back to all paths. A changed rule has a new version,
so only that rule runs again.

Positions without a UDF: the pieces between the matches (``split``) and the
matches (``regexp_extract_all``) of one pattern alternate, so running sums
of their lengths are the spans, in code points.

Defined results: a null text is the empty blob; equal texts, repeated rows
and equal paths are scanned once and all get the findings; a null doc_id is
carried like any column, whatever their names; an empty table gives an
empty result and writes nothing to the ledger.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortex.llm.common import row_of, rows_of, whole_text

LEDGER = "blob binary, rule string, rule_version string, spans array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` matches leftmost and non-overlapping; a match counts if
    its ``group`` has at least ``shortest`` characters. ``hint`` is a
    pattern that every text with a match contains."""

    name: str
    pattern: str
    group: int
    shortest: int
    hint: str

    @property
    def version(self) -> str:
        return hashlib.sha256(repr((self.pattern, self.group, self.shortest)).encode()).hexdigest()[:16]


# The order is the order of kinds among spans with the same start.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8,
         r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, r"AKIA[A-Z0-9]{12}"),
    Rule("hex", r"[0-9a-f]+", 0, 32, r"[0-9a-f]{32}"),
)


def spans_of(text: Column, rule: Rule) -> Column:
    """The rule's spans in ``text``: array of (start, end), end exclusive."""
    # a run of one class that is too short never hides a longer one, so such rules may ask for the length at once
    pattern = rule.pattern if rule.group else rule.pattern.removesuffix("+") + "{%d,}" % (rule.shortest - rule.pattern.startswith("AKIA") * 4)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)).alias("secret"))
    none = F.lit(None).cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state, p):
        begin = state["at"] + F.length(p["gap"])
        end = begin + F.coalesce(F.length(p["hit"]), F.lit(0))
        one = F.array(F.struct(begin.alias("start"), end.alias("end")))
        long_enough = F.length(p["secret"]) >= rule.shortest              # null after the last gap
        return F.struct(end.alias("at"), F.when(long_enough, F.concat(state["spans"], one))
                        .otherwise(state["spans"]).alias("spans"))

    empty = F.array().cast("array<struct<start:int,end:int>>")
    return F.when(text.isNull(), none).when(text.rlike(rule.hint), F.aggregate(parts, start, step)["spans"]).otherwise(empty)


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def update_ledger(versions: DataFrame, ledger_path: str, rules=RULES) -> DataFrame:
    """Scans what the ledger lacks of the texts in ``versions`` (column
    ``text``), appends it, and returns the ledger's rows for ``rules``."""
    spark = versions.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger_path)   # so that it exists
    ledger = spark.read.schema(LEDGER).parquet(ledger_path)
    texts = versions.select(whole_text().alias("text")).withColumn("blob", blob_of(F.col("text")))
    current = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("rule_version")) for r in rules])
    seen = (ledger.join(F.broadcast(spark.createDataFrame([(r.name, r.version) for r in rules], "rule string, rule_version string")),
                        ["rule", "rule_version"], "left_semi")
            .groupBy("blob").agg(F.collect_set(F.struct("rule", "rule_version")).alias("done")))  # at most one entry per rule
    # one copy of each blob (combined map-side), then the pairs that are left of it
    todo = (texts.groupBy("blob").agg(F.first("text").alias("text"))
            .join(seen, "blob", "left")
            .withColumn("todo", F.array_except(current, F.coalesce("done", F.array().cast("array<struct<rule:string,rule_version:string>>"))))
            .where(F.size("todo") > 0))
    has = lambda r: F.exists("todo", lambda t: t["rule"] == r.name)
    scanned = todo.select("blob", F.array(*[
        F.when(has(r), F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("rule_version"),
                                spans_of(F.col("text"), r).alias("spans"))) for r in rules]).alias("rows"))
    (scanned.select("blob", F.explode(F.filter("rows", lambda x: x.isNotNull())).alias("x"))
     .select("blob", "x.rule", "x.rule_version", "x.spans").write.mode("append").parquet(ledger_path))
    now = spark.read.schema(LEDGER).parquet(ledger_path)
    return now.join(F.broadcast(spark.createDataFrame([(r.name, r.version) for r in rules], "rule string, rule_version string")),
                    ["rule", "rule_version"], "left_semi")


def scan_versions(versions: DataFrame, ledger_path: str, rules=RULES) -> DataFrame:
    """One row per row of ``versions``: ``row``, all its columns as one, and
    ``found``, its spans as an array of (start, kind, end), by start, then
    by rule."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    ledger = update_ledger(versions, ledger_path, rules)
    # at most one entry per rule: a pair that two scans at once have both appended has the same spans twice
    per_blob = (ledger.where(F.size("spans") > 0).select("blob", F.struct("rule", "spans").alias("x"))
                .groupBy("blob").agg(F.collect_set("x").alias("xs")))
    spans = F.flatten(F.transform("xs", lambda x: F.transform(x["spans"], lambda s: F.struct(
        s["start"].alias("start"), order[x["rule"]].alias("rank"), s["end"].alias("end"), x["rule"].alias("kind")))))
    per_blob = per_blob.select("blob", F.array_sort(spans).alias("found"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return (versions.select(row_of(versions), blob_of(whole_text()).alias("blob")).join(per_blob, "blob", "left")
            .select("row", F.coalesce("found", none).alias("found")))


def span_text(found: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, found: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with every span, overlapping ones together, replaced."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, s):
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        fresh = s["start"] >= state["at"]
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"),
                        F.when(fresh, F.concat(state["out"], gap, F.lit(mask))).otherwise(state["out"]).alias("out"))

    done = F.aggregate(found, start, step)
    return F.when(F.size(found) == 0, text).otherwise(
        F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text) - done["at"])))


def redacted_documents(docs: DataFrame, ledger_path: str, rules=RULES) -> DataFrame:
    """``docs`` with the secrets in ``text`` masked, and ``n_chars``, where
    it exists, counted again for the changed texts."""
    hit, text = F.size("found") > 0, F.col("row")["text"]
    d = scan_versions(docs, ledger_path, rules).select(
        "row", hit.alias("hit"), F.when(hit, redact(text, F.col("found"))).otherwise(text).alias("masked"))
    d = d.withColumn("row", F.col("row").withField("text", F.col("masked")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        d = d.withColumn("row", F.col("row").withField("n_chars", F.when(F.col("hit"), F.length("masked").cast(kind))
                                                       .otherwise(F.col("row")["n_chars"])))
    return rows_of(d)
