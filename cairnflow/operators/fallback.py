"""A second, better pass over a transcript: which chunks it covers, which of its chunks are taken, and which result stands.

Runs, chunks, segments, drops and gaps are rows by item; every rule is a join or a group of its own, and their union is the choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reasons of drops that call for a second pass.
CRITICAL_DROPS = ("repetition_collapse", "long_token_artifact", "very_low_logprob_short_text", "multi_signal_low_quality")


def fallback_chunks(runs: DataFrame, chunks: DataFrame, drops: DataFrame, gaps: DataFrame, segments: DataFrame) -> DataFrame:
    """item, chunk of the second pass: the chunks of critical drops where a drop failed the run, those that reach past the last clean
    end or hold it where its tail failed, those over a gap where a gap did; an item without any takes the chunks of its low-confidence
    segments, and one without those all of its chunks.

    runs: item, failure, safety (null: safe), last_end; chunks: item, chunk, s, e; drops: item, chunk, reason; gaps: item, gs, ge;
    segments: item, chunk, flags."""
    starts = lambda c, *p: F.coalesce(c.rlike("^(?:" + "|".join(p) + ")"), F.lit(False))
    fail, safety = F.col("failure"), F.col("safety")
    known = chunks.select("item", "chunk")
    by_drop = runs.where(starts(fail, "quality_drop:")).join(drops.where(starts(F.col("reason"), *CRITICAL_DROPS)), "item").select("item", "chunk")
    by_tail = runs.where(starts(fail, "tail_gap_uncovered") | starts(safety, "tail_gap_uncovered")).join(chunks, "item").where((F.col("e") > F.col("last_end")) | (F.col("last_end").between(F.col("s"), F.col("e")))).select("item", "chunk")
    by_gap = runs.where(starts(fail, "vad_gap_uncovered")).join(gaps, "item").join(chunks, "item").where((F.col("e") > F.col("gs")) & (F.col("s") < F.col("ge"))).select("item", "chunk")
    unsure = segments.where(F.array_contains("flags", "low_confidence") | F.array_contains("flags", "very_low_logprob")).select("item", "chunk")
    ranked = by_drop.unionByName(by_tail).unionByName(by_gap).withColumn("rank", F.lit(0)).unionByName(unsure.withColumn("rank", F.lit(1))).unionByName(known.withColumn("rank", F.lit(2)))
    # the first rank that an item has decides for it, before chunks that it doesn't have go
    first = ranked.groupBy("item").agg(F.min("rank").alias("rank"))
    return ranked.join(first, ["item", "rank"]).join(runs.select("item"), "item", "left_semi").join(known, ["item", "chunk"], "left_semi").select("item", "chunk").distinct()


def regressed(fast: Column, quality: Column, seconds: float = 1.0, share: float = 0.05) -> Column:
    """Whether the second pass covers materially less clean speech of a chunk than the first."""
    return (fast > 0) & (quality + seconds < fast) & (quality < fast * (1 - share))


def replaced_chunks(fast: DataFrame, quality: DataFrame, chosen: DataFrame, keep_fast: bool = False) -> DataFrame:
    """The first pass's segments (item, chunk, s, e, clean, ...) with those of the chosen chunks (item, chunk) from the second, but of
    the chunks where that one regressed; ``source`` says which.  With keep_fast a replaced chunk keeps its old segments as well."""
    seconds = lambda d, name: d.where("clean").groupBy("item", "chunk").agg(F.sum(F.col("e") - F.col("s")).alias(name))
    c = chosen.distinct().join(seconds(fast, "_f"), ["item", "chunk"], "left").join(seconds(quality, "_q"), ["item", "chunk"], "left").na.fill(0.0, ["_f", "_q"])
    taken = c.where(~regressed(F.col("_f"), F.col("_q"))).select("item", "chunk")
    old = fast if keep_fast else fast.join(taken, ["item", "chunk"], "left_anti")
    return old.withColumn("source", F.lit("fast")).unionByName(quality.join(taken, ["item", "chunk"], "left_semi").withColumn("source", F.lit("quality")))


def select_result(fast_reason: Column, quality_reason: Column, fast_end: Column, quality_end: Column, expected: Column, failure: Column, seconds: float = 1.0, share: float = 0.05) -> Column:
    """struct(kept, reason) of two whole results, each safe where its reason is null."""
    cover = lambda end: F.when(expected > 0, F.least(F.lit(1.0), end / expected)).otherwise(1.0)
    ends = F.format_string("fast_end=%.2f:quality_end=%.2f", fast_end, quality_end)
    shorter = (quality_end + seconds < fast_end) & (cover(quality_end) + share < cover(fast_end))
    result = lambda kept, why: F.struct(F.lit(kept).alias("kept"), why.alias("reason"))
    both = lambda kept: result(kept, F.concat(F.lit("degraded_both_unsafe:fast="), fast_reason, F.lit(":quality="), quality_reason, F.lit(f":kept={kept}:"), ends))
    return (
        F.when(fast_reason.isNotNull() & quality_reason.isNotNull() & (quality_end >= fast_end), both("quality"))
        .when(fast_reason.isNotNull() & quality_reason.isNotNull(), both("fast"))
        .when(quality_reason.isNotNull(), result("fast", F.concat(F.lit("kept_fast:quality_unsafe:"), quality_reason)))
        .when(fast_reason.isNotNull(), result("quality", F.concat(F.lit("selected_quality:fast_unsafe:"), failure)))
        .when(shorter, result("fast", F.concat(F.lit("kept_fast:quality_coverage_worse:"), ends)))
        .otherwise(result("quality", F.concat(F.lit("selected_quality:fallback_reason="), failure)))
    )


def leaderboard(lines: DataFrame) -> DataFrame:
    """model, films, lines, agreement, coverage, consensus_precision of models that read films (model, film, line).

    Agreement is the mean Jaccard overlap with each other model of a film, coverage the share of all lines that any model read,
    consensus precision the share of a model's lines that another one read too; each a mean over the model's films."""
    x = lines.distinct()
    votes = x.groupBy("film", "line").agg(F.count("*").alias("votes"))
    own = x.join(votes, ["film", "line"]).groupBy("film", "model").agg(F.count("*").alias("n"), F.count_if(F.col("votes") > 1).alias("shared"))
    whole = votes.groupBy("film").agg(F.count("*").alias("all"))
    a, b = x.select("film", "line", F.col("model").alias("model")), x.select("film", "line", F.col("model").alias("other"))
    common = a.join(b, ["film", "line"]).where("model != other").groupBy("film", "model", "other").agg(F.count("*").alias("both"))
    pairs = own.select("film", "model", "n").join(own.select("film", F.col("model").alias("other"), F.col("n").alias("m")), "film").where("model != other")
    j = pairs.join(common, ["film", "model", "other"], "left").na.fill(0, ["both"]).groupBy("film", "model").agg(F.avg(F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("agree"))
    per = own.join(whole, "film").join(j, ["film", "model"], "left")
    return per.groupBy("model").agg(F.count("*").alias("films"), F.sum("n").alias("lines"), F.round(F.avg("agree"), 3).alias("agreement"), F.round(F.avg(F.col("n") / F.col("all")), 3).alias("coverage"), F.round(F.avg(F.col("shared") / F.col("n")), 3).alias("consensus_precision"))


def decision_hint(rows: DataFrame) -> DataFrame:
    """One hint over benchmark rows (sample, reference_ready, fast_safe)."""
    failed = F.array_join(F.array_sort(F.collect_list(F.when(F.col("fast_safe") == False, F.col("sample")))), ",")  # noqa: E712
    waits = F.coalesce(F.bool_or(~F.col("reference_ready")), F.lit(False))
    return rows.agg(F.when(waits, "awaiting_reference_transcripts").when(failed != "", F.concat(F.lit("not_final_fast_safety_failures:"), failed)).otherwise("ready_for_manual_decision_review").alias("hint"))


def drift(statuses: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Keys whose status isn't the one that the decision maps to; keys of one side alone say nothing."""
    return statuses.join(decisions, key).where(~F.col("status").eqNullSafe(F.col("mapped"))).select(key, "status", "mapped")
