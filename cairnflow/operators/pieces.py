"""Folds over a key's rows in order, in pieces that are folded at once.

A table is put in order of key and row and cut in pieces of bounded size; a key may fill any number of them.  Each piece is folded from what its
first key's state may be (the states a machine guesses), and says what state each guess leaves behind.  Those summaries compose: a scan over
the pieces of a key, a row each, finds the state that each piece really starts from.  Where it is none of the guesses, the piece is
folded again from it, and the scan goes on as if the first guess had been right; states are short memories, so what it left
is right already as a rule, and the rounds end when every piece was folded from the state that the one before left.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

PIECE = 1 << 14


@dataclass
class Machine:
    """step takes a state and a row to the next state and what the row lets out; finish what the last state lets out.  States are
    JSON; start is that of a key's first row.  An output with ``new`` true is counted: ``nth`` tells how many were, of its key, before it."""

    step: Callable[[object, dict], tuple[object, list[dict]]]
    finish: Callable[[object], list[dict]] = lambda state: []
    start: object = None
    guesses: list = field(default_factory=list)


def _runs(machine: Machine, keep: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Folds a piece: its outputs, by the state its first key was given, and rows that say what that state became."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at", kind="stable")
        piece, given = int(pdf["piece"].iloc[0]), pdf["given"].iloc[0]
        keys = pdf["key"].astype(object).where(pdf["key"].notna(), None).tolist()
        rows = pdf[keep].astype(object).where(pdf[keep].notna(), None).to_dict("records")
        cuts = [0] + [k for k in range(1, len(keys)) if keys[k] != keys[k - 1]] + [len(keys)]
        out: list[tuple] = []

        def through(lo: int, hi: int, state: object, guess: str, key: object) -> tuple[object, int]:
            n = 0
            for k in range(lo, hi):
                state, made = machine.step(state, rows[k])
                for m in made:
                    out.append((piece, key, guess, json.dumps(m), n, None, None))
                    n += bool(m.get("new", True))
            return state, n

        begins = [json.dumps(machine.start), *map(json.dumps, machine.guesses)] if not isinstance(given, str) else [given]
        for guess in dict.fromkeys(begins):
            state, n = through(cuts[0], cuts[1], json.loads(guess), guess, keys[0])
            out.append((piece, keys[0], guess, None, n, json.dumps(state), True))
        if not isinstance(given, str):
            for lo, hi in zip(cuts[1:-1], cuts[2:]):
                state, n = through(lo, hi, machine.start, "", keys[lo])
                out.append((piece, keys[lo], "", None, n, json.dumps(state), False))
        return pd.DataFrame(out, columns=["piece", "key", "guess", "made", "n", "state", "head"])

    return run


def _scan(machine: Machine) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The state that each of a key's pieces starts from, how many outputs were counted before it, and whether it is to be folded again."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        of: dict[int, dict] = {}
        for piece, guess, n, state, head in zip(pdf["piece"], pdf["guess"], pdf["n"], pdf["state"], pdf["head"]):
            of.setdefault(int(piece), {})[guess if head else None] = (state, int(n))
        state, count, out = json.dumps(machine.start), 0, []
        for piece in sorted(of):
            ways = of[piece]
            if None in ways:  # the key begins here, behind another one
                (after, n), begins, miss = ways[None], "", False
            else:
                miss, begins = state not in ways, state
                after, n = ways.get(state) or next(iter(ways.values()))
            out.append((piece, begins, count, miss, None))
            state, count = after, count + n
        out[-1] = (*out[-1][:4], state)
        return pd.DataFrame([(pdf["key"].iloc[0], *r, count) for r in out], columns=["key", "piece", "begins", "before", "miss", "left", "total"])

    return run


def fold_in_pieces(rows: DataFrame, by: str, order: list[str], machine: Machine, schema: str, piece: int = PIECE) -> DataFrame:
    """What the machine lets out over each key's rows in order: by, nth and the columns of schema.  Nulls of by are a key, and come first."""
    if piece & (piece - 1) or not 0 < piece <= 1 << 33:
        raise ValueError("piece is a power of two")
    keep = [c for c in rows.columns if c != by]
    d = rows.withColumnRenamed(by, "key")
    kind = d.schema["key"].dataType.simpleString()
    d = d.repartitionByRange("key", *order).sortWithinPartitions("key", *order).withColumn("at", F.monotonically_increasing_id())
    # a partition's numbers begin at a multiple of 2^33, so that no piece has rows of two
    d = written(d.withColumn("piece", F.expr(f"at div {piece}")).withColumn("given", F.lit(None).cast("string")), "ordered")
    ddl = f"piece long, key {kind}, guess string, made string, n long, state string, head boolean"
    tasks = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fold = lambda rows: written(rows.repartition(tasks, "piece").groupBy("piece").applyInPandas(_runs(machine, keep), ddl), "folded")
    done = fold(d)
    within = Window.partitionBy("key")
    while True:
        facts = done.where("made IS NULL").select("piece", "key", "guess", "n", "state", "head")
        facts = facts.withColumn("spans", F.min("piece").over(within) != F.max("piece").over(within))
        # most keys lie in one piece, which needs no scan: it starts from the first state
        one = facts.where(~F.col("spans") & (~F.col("head") | (F.col("guess") == json.dumps(machine.start))))
        one = one.select("key", "piece", F.when(F.col("head"), F.col("guess")).otherwise("").alias("begins"), F.lit(0).cast("long").alias("before"), F.lit(False).alias("miss"), F.col("state").alias("left"), F.col("n").alias("total"))
        several = facts.where("spans").drop("spans").groupBy("key").applyInPandas(_scan(machine), f"key {kind}, piece long, begins string, before long, miss boolean, left string, total long")
        scan = written(one.unionByName(several), "scan")
        missed = scan.where("miss").select("piece", F.col("key").alias("_k"), F.col("begins").alias("start"))
        if missed.isEmpty():
            break
        # the first key's rows of those pieces, from the states that they start from
        again = d.join(missed, "piece").where(F.col("key").eqNullSafe(F.col("_k"))).withColumn("given", F.col("start")).select(d.columns)
        done = done.unionByName(fold(again))
    real = scan.select(F.col("piece").alias("_p"), F.col("key").alias("_k"), "begins", "before")
    out = done.where("made IS NOT NULL").join(real, (F.col("piece") == F.col("_p")) & F.col("key").eqNullSafe(F.col("_k")) & (F.col("guess") == F.col("begins")))
    out = out.select("key", (F.col("before") + F.col("n")).alias("nth"), "made")

    def ends(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            got = [(k, t, json.dumps(m)) for k, t, left in zip(pdf["key"], pdf["total"], pdf["left"]) for t, m in _numbered(t, machine.finish(json.loads(left)))]
            yield pd.DataFrame(got, columns=["key", "nth", "made"])

    last = scan.where("left IS NOT NULL").select("key", "total", "left").mapInPandas(ends, f"key {kind}, nth long, made string")
    return out.unionByName(last).select(F.col("key").alias(by), "nth", F.from_json("made", schema).alias("m")).select(by, "nth", "m.*")


def _numbered(n: int, made: Iterable[dict]) -> Iterator[tuple[int, dict]]:
    for m in made:
        yield n, m
        n += bool(m.get("new", True))


def capped_merge(max_seconds: float, gap: float) -> Machine:
    """Intervals (s, e) joined while the pause is at most gap and the whole at most max_seconds: s, e, n."""

    def step(g: list | None, r: dict) -> tuple[object, list[dict]]:
        if g and r["s"] - g[1] <= gap and r["e"] - g[0] <= max_seconds:
            return [g[0], r["e"], g[2] + 1], []
        return [r["s"], r["e"], 1], _group(g)

    return Machine(step, _group)


def _group(g: list | None) -> list[dict]:
    return [{"s": g[0], "e": g[1], "n": g[2]}] if g else []


def merge_windows(gap: float) -> Machine:
    """Neighbours of one type within gap are joined; metric is the pairwise mean from the left: s, e, type, metric."""
    give = lambda g: [dict(zip(("s", "e", "type", "metric"), g))] if g else []

    def step(g: list | None, r: dict) -> tuple[object, list[dict]]:
        if g and g[2] == r["type"] and r["s"] - g[1] <= gap:
            return [g[0], r["e"], g[2], (g[3] + r["metric"]) / 2], []
        return [r["s"], r["e"], r["type"], r["metric"]], give(g)

    return Machine(step, give)


def smooth_bridges(unknown: str, seconds: float) -> Machine:
    """X, a short unknown, X becomes X; three rows are used up at a time, from the left: s, e, type.  The state is what waits for the rows behind it."""
    give = lambda w: [dict(zip(("s", "e", "type"), x)) for x in w or []]

    def step(w: list | None, r: dict) -> tuple[object, list[dict]]:
        w = [*(w or []), [r["s"], r["e"], r["type"]]]
        if len(w) == 3 and w[0][2] == w[2][2] and w[1][2] == unknown and w[1][1] - w[1][0] <= seconds:
            return [], give([[w[0][0], w[2][1], w[0][2]]])
        return (w[1:], give(w[:1])) if len(w) == 3 else (w, [])

    return Machine(step, give)


def overlap_groups(least: float) -> Machine:
    """Rows join the group whose window, grown by its rows, they overlap by at least this share of the shorter one: s, e, n."""

    def step(g: list | None, r: dict) -> tuple[object, list[dict]]:
        if g:
            both = max(0.0, min(g[1], r["e"]) - max(g[0], r["s"]))
            short = min(g[1] - g[0], r["e"] - r["s"])
            if (both / short if short > 0 else float(both > 0)) >= least:
                return [min(g[0], r["s"]), max(g[1], r["e"]), g[2] + 1], []
        return [r["s"], r["e"], 1], _group(g)

    return Machine(step, _group)


def anchors(threshold: int) -> Machine:
    """Each row's pos, and whether its hash is further than threshold bits from the first of the cluster before it, so that it begins one."""

    def step(anchor: int | None, r: dict) -> tuple[object, list[dict]]:
        near = anchor is not None and r["hash"] is not None and (anchor ^ int(r["hash"])).bit_count() <= threshold
        return anchor if near else None if r["hash"] is None else int(r["hash"]), [{"pos": r["pos"], "new": not near}]

    return Machine(step)


def regimes(unknown: str, tolerance: int) -> Machine:
    """Runs of a label over up to tolerance unknown rows between them: label, first, last, n.  The state is the open run and the unknown rows since."""
    give = lambda w: [dict(zip(("label", "first", "last", "n"), w[:4]))] if w else []

    def step(w: list | None, r: dict) -> tuple[object, list[dict]]:
        if r["label"] == unknown:
            return (None, []) if not w else ([*w[:4], w[4] + 1], []) if w[4] < tolerance else (None, give(w))
        if w and w[0] == r["label"]:
            return [w[0], w[1], r["pos"], w[3] + 1, 0], []
        return [r["label"], r["pos"], r["pos"], 1, 0], give(w)

    return Machine(step, give)


def merged_chunks(rows: DataFrame, by: str, order: list[str], duration: float, min_seconds: float, max_seconds: float, gap: float, padding: float, piece: int = PIECE) -> DataFrame:
    """by, chunk, s, e and n: intervals (s, e) merged as ``capped_merge`` does, then short ones widened into the free time around them, cut at the middle between neighbours, padded."""
    g = fold_in_pieces(rows, by, order, capped_merge(max_seconds, gap), "s double, e double, n int", piece)
    w = Window.partitionBy(by).orderBy("nth")
    c, zero, end = F.col, F.lit(0.0), F.lit(duration)
    inside = lambda x: F.greatest(zero, F.least(end, x))
    g = g.withColumns({"lo": F.coalesce(F.lag("e").over(w), zero), "hi": F.coalesce(F.lead("s").over(w), end)}).withColumns({"s": inside(c("s")), "e": inside(c("e"))}).where("e > s")
    g = g.withColumn("lack", F.least(F.lit(min_seconds) - (c("e") - c("s")), F.greatest(zero, c("hi") - c("lo") - (c("e") - c("s")))))
    g = g.withColumn("ahead", F.least(c("lack") / 2, F.greatest(zero, c("s") - c("lo")))).withColumn("behind", F.least(c("lack") - c("ahead"), F.greatest(zero, c("hi") - c("e"))))
    g = g.withColumn("ahead", F.least(F.greatest(zero, c("s") - c("lo")), c("ahead") + F.greatest(zero, c("lack") - c("ahead") - c("behind"))))
    short = c("lack") > 0
    g = g.withColumns({"s": F.when(short, F.greatest(c("lo"), c("s") - c("ahead"))).otherwise(c("s")), "e": F.when(short, F.least(c("hi"), c("e") + c("behind"))).otherwise(c("e"))})
    # the cut before a chunk is the latest middle so far
    before = F.lag("e").over(w)
    g = g.withColumn("cut", F.when(before.isNotNull(), F.least(end, (before + c("s")) / 2)))
    g = g.withColumn("cut", F.greatest(zero, F.coalesce(F.max("cut").over(w), zero)))
    g = g.withColumn("next", F.coalesce(F.lead("cut").over(w), end))
    g = g.withColumns({"s": F.greatest(c("cut"), c("s") - padding, zero), "e": F.least(c("next"), c("e") + padding, end)}).where(c("e") - c("s") >= 0.1)
    return g.select(by, (F.row_number().over(w) - 1).alias("chunk"), F.bround("s", 3).alias("s"), F.bround("e", 3).alias("e"), "n")


def thinned(rows: DataFrame, by: str, pos: str, hash_: str, threshold: int, keep: int, piece: int = PIECE) -> DataFrame:
    """by and pos of the rows that stay: those near the first of their cluster join it, and keep evenly spaced ones of each cluster stay."""
    r = fold_in_pieces(rows.select(by, F.col(pos).alias("pos"), F.col(hash_).alias("hash")), by, ["pos"], anchors(threshold), "pos long, new boolean", piece)
    r = r.withColumn("cluster", F.col("nth") - F.when(F.col("new"), 0).otherwise(1))
    k = Window.partitionBy(by, "cluster").orderBy("pos")
    n = r.groupBy(by, "cluster").agg(F.count("*").alias("n"))
    r = r.withColumn("k", F.row_number().over(k) - 1).join(n.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")) & (r["cluster"] == n["cluster"]))
    stays = F.col("k") == 0 if keep == 1 else F.array_contains(F.transform(F.sequence(F.lit(0), F.lit(keep - 1)), lambda t: F.bround(t * (F.col("n") - 1) / (keep - 1)).cast("int")), F.col("k"))
    return r.where((F.col("n") <= keep) | stays).select(by, F.col("pos").alias(pos))


def onsets(rows: DataFrame, by: str, label: str, floor: float, unknown: str, missing: str, tolerance: int, confirm: int, piece: int = PIECE) -> DataFrame:
    """by, decision and onset: where label begins in each key's rows (pos, label, confidence).  Rows under the confidence floor count as
    unknown; one confirmed run is FOUND, several are REVIEW, none NONE, rows that are all missing MODEL_ERROR, and positions that aren't consecutive GAP."""
    known = F.when((F.col("confidence") < floor) | (F.col("label") == missing), unknown).otherwise(F.col("label"))
    r = fold_in_pieces(rows.select(by, "pos", known.alias("label")), by, ["pos"], regimes(unknown, tolerance), "label string, first long, last long, n long", piece)
    r = r.where((F.col("n") >= confirm) & (F.col("label") == label)).groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("runs"), F.min("first").alias("first"))
    all_ = rows.groupBy(by).agg(F.count("*").alias("n"), F.count_distinct("pos").alias("places"), (F.max("pos") - F.min("pos") + 1).alias("span"), F.bool_and(F.coalesce(F.col("label") == missing, F.lit(False))).alias("none"))
    gap = (F.col("n") != F.col("span")) | (F.col("places") != F.col("n"))
    decision = F.when(gap, "GAP").when(F.col("none"), "MODEL_ERROR").when(F.col("runs").isNull(), "NONE").when(F.col("runs") == 1, "FOUND").otherwise("REVIEW")
    return all_.join(r, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, decision.alias("decision"), F.when(~gap & ~F.col("none"), F.col("first")).alias("onset"))
