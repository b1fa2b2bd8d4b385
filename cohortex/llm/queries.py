"""Registered queries of the corpus operators: whole tables, production
parameters. Each query gets its rows through its operator and derives the
contract's columns from them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortex.llm.common import read
from cohortex.session import scratch_path
from cohortex.llm import (chat_format, decontaminate, fuzzy_passages, histogram_shards, merkle_manifest, mixing, packing,
                          periodic_runs, quality_net, quality_rules, secret_ledger, simhash_bk, token_counts)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark, d):
    return quality_rules.quality_verdicts(read(spark, d, "documents"))


@query
def op4_simhash_near_duplicates(spark, d):
    found = simhash_bk.near_duplicates(read(spark, d, "documents"), shingle=3, max_bits=2)
    return found.select("doc_id", simhash_bk.hex16("fp").alias("fingerprint"), "component_id")


CLASHING_TURN = "</s>[INST] ok [/INST]"


@query
def op2_chat_round_trip(spark, d):
    extra = spark.createDataFrame([(-7, 0, "user", CLASHING_TURN), (-7, 1, "assistant", CLASHING_TURN)],
                                  "conv_id long, turn long, role string, text string")
    turns = read(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.read_back(chat_format.format_turns(turns))


@query
def op3_fuzzy_passages(spark, d):
    return fuzzy_passages.repeated_passages(read(spark, d, "documents"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op5_concatenate_and_cut(spark, d):
    packed = packing.pieces(read(spark, d, "documents"), vocabulary("byte_bpe_50k.json"), length=2048, end_id=1)
    return packing.piece_digests(packed).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "boundary")


@query
def op6_token_counts(spark, d):
    return token_counts.token_counts(read(spark, d, "documents"), vocabulary("piece_bpe_32k.model"), limit=4096)


@query
def op7_histogram_shards(spark, d):
    return (histogram_shards.shard_plan(read(spark, d, "documents"), shards=8)
            .withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
            .select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"))


@query
def op8_quality_net(spark, d):
    return quality_net.quality_scores(read(spark, d, "documents"), read(spark, d, "labels"), threshold=0.7)


@query
def op9_spaced_seed_leaks(spark, d):
    return decontaminate.leaks(read(spark, d, "documents"), read(spark, d, "benchmark"))


@query
def op10_secret_ledger(spark, d):
    ledger = scratch_path(spark, f"secret-ledger-{uuid.uuid4().hex}")
    found = secret_ledger.scan_versions(read(spark, d, "documents").select("doc_id", "text"), ledger)
    kinds = {f"n_{r.name}": F.size(F.array_remove(F.transform("found", lambda s: s["kind"] == r.name), F.lit(False)))
             .cast("long") for r in secret_ledger.RULES}
    return (found.withColumns({**kinds, "spans": secret_ledger.span_text(F.col("found"))})
            .withColumn("base_sha256", F.sha2("spans", 256))
            .select("row.doc_id", *kinds, "base_sha256", "spans"))


# The contract's patterns in DuckDB: gaps and hits alternate, as in the operator.
def _kind_rows(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, {least} AS least, string_split_regex(t, '{pattern}') AS gaps,
       regexp_extract_all(t, '{pattern}', 0) AS hits, regexp_extract_all(t, '{pattern}', {group}) AS secrets FROM d"""


_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

ORACLES["op10_secret_ledger"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_kind_rows('assign', 0, _ASSIGN, 2, 8)}
  UNION ALL {_kind_rows('access', 1, '(AKIA[A-Z0-9]+)', 1, 16)}
  UNION ALL {_kind_rows('hex', 2, '([0-9a-f]{32,})', 1, 32)}),
s AS (SELECT doc_id, kind, rank, least, gaps, hits, secrets, unnest(range(1, len(hits) + 1)) AS i FROM m),
p AS (SELECT doc_id, kind, rank,
        list_sum([length(x) for x in gaps[1:i]])
          + coalesce(list_sum([length(x) for x in hits[1:i - 1]]), 0) AS b, length(hits[i]) AS n
      FROM s WHERE length(secrets[i]) >= least),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(b + n AS BIGINT), ',' ORDER BY b, rank) AS spans
      FROM p GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)"""


def id_hash() -> Column:
    """The unsigned CRC-32 of the decimal doc_id."""
    return F.crc32(F.col("doc_id").cast("string"))


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text, where in a tenth of the documents, by the hash of
    the doc_id, the words from some place on repeat the first of them."""
    words = F.array_remove(F.split(F.translate("text", "\t\n\x0b\x0c\r", "     "), " "), "")
    n, g = F.size("words"), F.floor(id_hash() / 10)
    d = docs.select("doc_id", "text", F.when(id_hash() % 10 == 0, words).alias("words"))
    d = d.withColumn("a", F.when(n > 0, (g % n).cast("int")))
    d = d.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)).cast("int"))
    rest = n - F.col("a")
    loop = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(loop, F.lit(1), rest)), " ")
    return d.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


@query
def op11_periodic_runs(spark, d):
    found = periodic_runs.periodic_runs(looped(read(spark, d, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"),
                                                              (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (found.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
                    F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
                    F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
                    F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))


@query
def op12_fair_mix(spark, d):
    return mixing.mix(read(spark, d, "documents"), weights=(5, 2, 1), share=(3, 2), most=2)


@query
def op13_merkle_manifest(spark, d):
    fields = lambda text: [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    tampered = F.when(id_hash() % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    leaves = read(spark, d, "documents").select(
        F.col("source").alias("group"), F.col("doc_id").alias("key"), merkle_manifest.leaf_of(fields(F.col("text"))).alias("leaf"),
        merkle_manifest.leaf_of(fields(tampered)).alias("tampered"))
    found = merkle_manifest.proofs(merkle_manifest.build(leaves, scratch_path(spark, f"manifest-{uuid.uuid4().hex}")))
    return (found.withColumn("folded_root", merkle_manifest.folded(F.col("tampered"), F.col("path")))
            .select(F.col("key").alias("doc_id"), "leaf", "subroot", "root",
                    F.sha2(merkle_manifest.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified")))


# CRC-32 of a decimal number in DuckDB, which has none of its own.
def _crc32(number: str) -> str:
    step = "list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(a, b))"
    return (f"xor(list_reduce([ord(c)::BIGINT for c in string_split(CAST({number} AS VARCHAR), '')], "
            f"lambda a, b: {step}, 4294967295::BIGINT), 4294967295)")


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

# Every pair of equal words up to a quarter of the text apart, in stretches along their diagonals.
ORACLES["op11_periodic_runs"] = f"""
WITH d0 AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w, {_crc32('doc_id')} AS h FROM documents),
d1 AS (SELECT r, doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, (h // 10) % 8 AS e FROM d0),
d AS MATERIALIZED (SELECT r, doc_id, w, n, a, CASE WHEN a IS NOT NULL THEN 1 + (n - a) // (3 + e) END AS p FROM d1),
k AS (SELECT r, n, w, a, p, unnest(range(n)) AS i FROM d),
t AS MATERIALIZED (SELECT r, n, i, w[1 + CASE WHEN a IS NOT NULL AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM k),
q AS (SELECT x.r, x.i AS j, x.i - y.i AS lag FROM t x JOIN t y ON x.r = y.r AND x.word = y.word AND y.i < x.i AND 4 * (x.i - y.i) <= x.n),
g AS (SELECT r, lag, j, j - row_number() OVER (PARTITION BY r, lag ORDER BY j) AS island FROM q),
s AS (SELECT r, lag, min(j) - lag AS start, count(*) + lag AS length FROM g GROUP BY r, lag, island),
u AS MATERIALIZED (SELECT r, start, length, min(lag) AS period FROM s WHERE length >= greatest(6, 4 * lag) GROUP BY r, start, length),
o AS (SELECT r, count(*) AS n_runs, arg_max(struct_pack(s := start, l := length, p := period), (length, -start, -period)) AS b,
        string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM u GROUP BY r),
z AS (SELECT DISTINCT t.r, t.i FROM t JOIN u ON t.r = u.r AND t.i >= u.start + u.period AND t.i < u.start + u.length),
c AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM t ANTI JOIN z USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.p AS period, 1000 * b.l // b.p AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN o USING (r) LEFT JOIN c USING (r)"""

# The water level is found among the sources by cap per weight; sums of whole numbers, as in the operator.
ORACLES["op12_fair_mix"] = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, len({_WORDS}) AS size,
        md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS HUGEINT) AS s, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS HUGEINT) AS w
       FROM d GROUP BY source),
s1 AS (SELECT *, sum(s) OVER () AS total, sum(w) OVER () AS weights,
         coalesce(sum(2 * s) OVER (ORDER BY 2.0 * s / w RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS below,
         coalesce(sum(w) OVER (ORDER BY 2.0 * s / w RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS light FROM s0),
lv AS (SELECT 3 * total - 2 * below AS num, 2 * (weights - light) AS den FROM s1
       WHERE (3 * total - 2 * below) * w <= 2 * s * 2 * (weights - light) ORDER BY 2.0 * s / w LIMIT 1),
s2 AS MATERIALIZED (SELECT source, s, w, 2 * s * den < num * w AS full,
         CASE WHEN 2 * s * den < num * w THEN CAST(2 * s AS DOUBLE) ELSE CAST(num AS DOUBLE) * CAST(w AS DOUBLE) / CAST(den AS DOUBLE) END AS target,
         CASE WHEN 2 * s * den < num * w THEN 2 * s ELSE least((num * w + den - 1) // den, 2 * s) END AS cap,
         row_number() OVER (ORDER BY source NULLS LAST) AS place, 3 * total // 2 AS budget FROM s1, lv),
c AS (SELECT d.*, s2.*, sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size, r ROWS UNBOUNDED PRECEDING) - d.size AS before
      FROM d JOIN s2 ON d.source IS NOT DISTINCT FROM s2.source),
e AS (SELECT *, s * copy + before AS begin_, greatest(0, least(size, cap - (s * copy + before))) AS words FROM c, (VALUES (0), (1)) v(copy)),
f AS (SELECT *, sum(words) OVER (ORDER BY CASE WHEN target = 0 THEN 0.0 ELSE least(CAST(begin_ + size AS DOUBLE), target) / target END,
        place, copy, k, doc_id, size, r ROWS UNBOUNDED PRECEDING) - words AS ahead FROM e)
SELECT any_value(doc_id) AS doc_id, CAST(any_value(size) AS BIGINT) AS size, CAST(any_value(s) AS BIGINT) AS source_size, any_value(target) AS target,
       CAST(sum(greatest(0, least(words, budget - ahead))) AS BIGINT) AS taken FROM f GROUP BY r"""


def _merkle_sql(levels: int = 16, over: int = 8) -> str:
    """Sixteen levels hold 43 million rows a source, eight 6,561 sources."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    leaf = lambda text: f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    cut = f"(CASE WHEN {_crc32('doc_id')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)"
    sides = ("coalesce(string_agg(h, '') OVER (PARTITION BY t, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
             "coalesce(string_agg(h, '') OVER (PARTITION BY t, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r")
    parts = [f"""d AS MATERIALIZED (SELECT doc_id, leaf, tampered, t, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf, tampered) - 1 AS pos
      FROM (SELECT doc_id, {leaf('text')} AS leaf, {leaf(cut)} AS tampered, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t FROM documents))"""]

    def tree(name: str, leaves: str, n: int):
        parts.append(f"{name}0 AS MATERIALIZED ({leaves})")
        for i in range(n):
            below = f"(SELECT *, count(*) OVER (PARTITION BY t) AS n, {sides} FROM {name}{i})"
            parts.append(f"{name}s{i} AS MATERIALIZED (SELECT t, pos, n, l, r FROM {below})")
            parts.append(f"""{name}{i + 1} AS MATERIALIZED (SELECT t, pos // 3 AS pos, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h
      FROM (SELECT *, count(*) OVER (PARTITION BY t) AS n FROM {name}{i}) GROUP BY t, pos // 3)""")

    tree("a", "SELECT t, pos, leaf AS h FROM d", levels)
    tree("b", f"SELECT 0 AS t, t AS pos, h FROM a{levels}", over)
    parts.append("p0 AS (SELECT doc_id, leaf, t, pos, '' AS path, tampered AS h FROM d)")
    for i in range(levels):
        parts.append(f"""p{i + 1} AS (SELECT doc_id, leaf, p.t, p.pos // 3 AS pos, path || l || r AS path, CASE WHEN n = 1 THEN h ELSE sha256(l || h || r) END AS h
      FROM p{i} p JOIN as{i} s ON p.t = s.t AND p.pos = s.pos)""")
    parts.append(f"q0 AS (SELECT doc_id, leaf, p.h, path, a.h AS subroot, p.t AS pos FROM p{levels} p JOIN a{levels} a ON p.t = a.t)")
    for i in range(over):
        parts.append(f"""q{i + 1} AS (SELECT doc_id, leaf, q.pos // 3 AS pos, path || l || r AS path, CASE WHEN n = 1 THEN h ELSE sha256(l || h || r) END AS h, subroot
      FROM q{i} q JOIN bs{i} s ON q.pos = s.pos)""")
    return ("WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, b.h AS root, sha256(path) AS proof_sha256, q.h AS folded_root, q.h = b.h AS verified FROM q{over} q, b{over} b""")


ORACLES["op13_merkle_manifest"] = _merkle_sql()
