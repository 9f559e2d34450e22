"""Quality rules with host verdicts, in DataFrame functions only.

Base rules judge each document alone.  Failures are then counted by host; the rates are shrunk toward the hosts' mean by a
beta prior fitted to them by the method of moments, so that a host with few documents isn't judged by chance.  A host is rejected
when all but the lowest twentieth of its posterior lies at ``host_limit`` or above: when it is all but certain that at least half of
what it sends fails.  That verdict is joined back to its documents.

Scale: one pass over the texts writes a narrow table of counts to the shared folder; the counts by host combine before the
shuffle, so a hot host costs one row a task; the join back carries no text, and the table of hosts is broadcast only when its
written size is under Spark's threshold, else the join is a shuffled one whose hot keys AQE splits.  ``keep`` writes the rows
themselves with their base verdicts, so that none is looked up by its doc_id.

Defined results: a null or empty text, or one of white space, has no words and fails the base rules.  A null host is a host of
its own.  Repeated rows each get a row and count for their host.  An empty table gives an empty result.  Other columns of the
input are ignored and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, quoted

#: A word is a run of other characters; the symbols that are counted.
GAP, SYMBOLS = r"[\x20\x09-\x0D]+", "[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A host is rejected when its failure rate is at least this, by the posterior's mean less so many of its standard deviations.
HOST_LIMIT, DEVIATIONS = 0.5, 1.645
#: Documents that a prior fitted from nothing (one host, or hosts all alike) is worth.
PRIOR_WEIGHT, MAX_PRIOR_WEIGHT = 20.0, 1000.0


def word_array(text: Column) -> Column:
    """Words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def document_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host and the base counts of each row."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = d.withColumns({"w": word_array(F.col("t")), "lines": F.filter(F.split("t", "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)})
    d = d.select("doc_id", "host", "w", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
                 F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    # windows of three words as (hash, start), sorted, so that equal windows stand side by side
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    d = d.withColumn("win", F.when(F.col("n_words") >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 3), lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("p"))))).otherwise(none)).drop("w")
    again = F.filter("win", lambda x, i: F.get("win", i - 1)["h"].eqNullSafe(x["h"]) | F.get("win", i + 1)["h"].eqNullSafe(x["h"]))
    d = d.withColumn("at", F.sort_array(F.transform(again, lambda x: x["p"]))).drop("win")
    # words under the union of the repeated windows [p, p + 3)
    covered = F.aggregate(F.transform("at", lambda p, i: F.when(i + 1 < F.size("at"), F.least(F.lit(3), F.get("at", i + 1) - p)).otherwise(3)), F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))


def with_base_verdict(counts: DataFrame) -> DataFrame:
    return counts.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_verdicts(judged: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """host, n_docs, n_failed, shrunk rate and host_rejected; judged has host and base_failed."""
    hosts = materialise(judged.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")), "hosts")
    rate = F.col("n_failed") / F.col("n_docs")
    m = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.count("*").alias("hosts"), F.avg(rate).alias("mean"), F.var_samp(rate).alias("var"), F.avg(1 / F.col("n_docs")).alias("inv")).first()
    alpha, beta = beta_prior(m["n"], m["f"], m["hosts"], m["mean"], m["var"], m["inv"])
    size = F.col("n_docs") + F.lit(alpha + beta)
    shrunk = (F.col("n_failed") + F.lit(alpha)) / size
    low = shrunk - DEVIATIONS * F.sqrt(shrunk * (1 - shrunk) / (size + 1))
    return hosts.withColumn("rate", shrunk).withColumn("host_rejected", low >= F.lit(float(host_limit)))


def beta_prior(n: int | None, failed: int | None, hosts: int, mean: float | None, var: float | None, inv: float | None) -> tuple[float, float]:
    """alpha, beta from the hosts' rates: their variance less what chance gives hosts of that size, by the method of moments."""
    if not n:
        return 0.5 * PRIOR_WEIGHT, 0.5 * PRIOR_WEIGHT
    mean = min(max(float(mean), 1 / (2.0 * n + 2)), 1 - 1 / (2.0 * n + 2))
    weight = PRIOR_WEIGHT
    if hosts > 1 and var is not None:
        chance = mean * (1 - mean) * float(inv)
        left = float(var) - chance
        weight = MAX_PRIOR_WEIGHT if left <= 0 else min(MAX_PRIOR_WEIGHT, max(1.0, mean * (1 - mean) / left - 1))
    return mean * weight, (1 - mean) * weight


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """A row for each document: doc_id, host, the counts, base_failed, host_rate, host_rejected, kept."""
    judged = materialise(with_base_verdict(document_counts(docs, doc_id, text, host)), "hostrules")
    hosts = materialise(host_verdicts(judged, host_limit).select(F.col("host").alias("_host"), F.col("rate").alias("host_rate"), "host_rejected"), "verdicts")
    out = judged.join(hosts, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def keep(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of docs that are kept, with their columns: each by its own base verdict and that of its host, whatever its doc_id."""
    own = docs.select(F.struct(*(F.col(quoted(c)).alias(c) for c in docs.columns)).alias("row"), "text", "source")
    judged = with_base_verdict(document_counts(own, "row")).select(F.col("doc_id").alias("row"), "host", "base_failed")
    judged = materialise(judged, "hostrules")
    bad = materialise(host_verdicts(judged, host_limit).where("host_rejected").select(F.col("host").alias("_host")), "verdicts")
    return judged.where(~F.col("base_failed")).join(bad, F.col("host").eqNullSafe(F.col("_host")), "left_anti").select(*[F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns])
