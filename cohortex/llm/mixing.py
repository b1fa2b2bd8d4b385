"""Mixing sources to target weights by weighted fair queueing, in DataFrame
functions only.

Every source is a queue and its share of the mix its weight. A source's
documents are shuffled by a hash of (seed, doc_id); copy c of a document
starts after c whole passes over the source and after what lies before it
in the shuffle. Its virtual finish time is the source's words so far,
itself included, divided by the source's target. Served in order of finish
time, all sources reach their targets together, at time 1, when the budget
is spent: a document then in service finishes there, cut to the words up to
its source's target (rounded up to a word). One range sort by finish time
puts the whole mix in order, and running totals truncate it at the budget.

Targets: sources by code point, null last, have ``weights`` in turn and
share ``share`` (a fraction) of all words; a target stops at ``most`` times
its source, and the excess goes to the others by weight, in rounds of one
small aggregate until no target is above its limit. The arithmetic is in
whole numbers, so that reruns agree to the last bit.

Running totals over all rows come from a range sort, totals per block of
rows, and totals per partition, and a source's rows are dealt to many tasks
where its figures join them: a source with a third of all rows is spread
like any other rows.

Defined results: a null or empty text has size 0 and takes 0 words; a null
source is a source of its own, the last; null doc_ids shuffle as the empty
text; rows that share a doc_id are documents of their own, equal ones
interchangeable; sources without a word have target 0; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortex.llm.common import reliable, written
from cohortex.operators.indexing import join_groups, running_totals, with_row_index


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    plain = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.array_remove(F.split(plain, " "), "")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """Of (source, source_size): source, source_size, place, weight, target
    (double) and limit (the target, rounded up to a whole word)."""
    of = F.array(*[F.lit(w) for w in weights])
    s = with_row_index(sizes, "place", [F.col("source").asc_nulls_last()])
    s = s.withColumn("weight", F.element_at(of, (F.col("place") % len(weights) + 1).cast("int")).cast("long"))
    s = reliable(s.withColumn("_cap", F.col("source_size") * most))
    total, weight = s.agg(F.sum("source_size"), F.sum("weight")).first()
    # what is left for one unit of weight is left / (part * weight); a source is at its limit if its cap is less than its part
    left, part, weight = (total or 0) * share[0], share[1], weight or 1

    def capped():
        return F.col("_cap").cast("decimal(38,0)") * F.lit(part * weight) < F.col("weight") * F.lit(left).cast("decimal(38,0)")

    full = -1
    while True:
        cap, light, rows = s.where(capped()).agg(F.sum("_cap"), F.sum("weight"), F.count("*")).first()
        if rows == full or rows == 0:
            break
        full = rows
        all_weight = s.agg(F.sum("weight")).first()[0]
        left, weight = total * share[0] - share[1] * cap, all_weight - light
        if weight == 0:                                                       # every source is at its limit
            left, weight = 1 << 62, 1
            break
    exact = F.lit(float(left)) * F.col("weight").cast("double") / F.lit(float(part * weight))
    whole = F.ceil(F.col("weight") * F.lit(left).cast("decimal(38,0)") / F.lit(part * weight).cast("decimal(20,0)"))
    return s.select("source", "source_size", "place", "weight",
                    F.when(capped(), F.col("_cap").cast("double")).otherwise(exact).alias("target"),
                    F.when(capped(), F.col("_cap")).otherwise(F.least(whole.cast("long"), F.col("_cap"))).alias("limit"))


def schedule(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2,
             seed: str = "mix") -> DataFrame:
    """The mix in order: rows (row, doc_id, source, size, source_size,
    target, copy, finish, at, taken). ``row`` names the document, ``at`` is
    the mix's words before the copy and ``taken`` those of the copy, from
    its first; every document has its copy 0, also where that takes none."""
    shuffled = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    light = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"),
                                shuffled.alias("_key"), F.xxhash64("text").alias("_text")), "mix-sizes")
    per_source = targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    total = per_source.agg(F.sum("source_size")).first()[0] or 0
    rows = running_totals(light, [F.col("source").asc_nulls_last(), "_key", "doc_id", "size", "_text"], "size", "_before", "row")
    begins = rows.groupBy(F.col("source").alias("_source")).agg(F.min("_before").alias("_begin"))
    per_source = per_source.join(begins, F.col("source").eqNullSafe(F.col("_source"))).drop("source")
    rows = join_groups(rows, per_source, "source", "_source", "row")
    start = F.col("source_size") * F.col("copy") + F.col("_before") - F.col("_begin")
    copies = (rows.withColumn("copy", F.explode(F.array(*[F.lit(c) for c in range(most)])))
              .withColumn("_words", F.greatest(F.lit(0), F.least(F.col("size"), F.col("limit") - start)))
              .where((F.col("_words") > 0) | (F.col("copy") == 0))
              .withColumn("finish", F.coalesce(F.try_divide(F.least((start + F.col("size")).cast("double"), F.col("target")),
                                                            F.col("target")), F.lit(0.0))))
    names = ["row", "doc_id", "source", "size", "source_size", "target", "copy", "finish"]
    mixed = running_totals(copies.select(*names, "place", "_words"), ["finish", "place", "copy", "row"], "_words", "at", "_at")
    budget = total * share[0] // share[1]
    return mixed.select(*names, "at", F.greatest(F.lit(0), F.least(F.col("_words"), F.lit(budget) - F.col("at"))).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2,
        seed: str = "mix") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken."""
    s = schedule(docs, weights, share, most, seed)
    keep = ["doc_id", "size", "source_size", "target"]
    return (s.groupBy("row").agg(*[F.first(c).alias(c) for c in keep], F.sum("taken").alias("taken"))
            .select(*keep, "taken"))
