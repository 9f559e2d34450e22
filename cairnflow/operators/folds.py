"""Operators whose result depends on the order of rows, one key at a time.

Each is a plain function from a key's rows, in a total order, to rows, run as a grouped map; a key is one recording, series or
engine, whose rows fit a task by their nature.  Where windows can say the same, ``runs`` and ``intervals`` have it.
"""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.similarity import ratio_from


def grouped(rows: DataFrame, by: str, order: list[str], fold: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """fold over each key's rows in order; the schema's first column is the key."""
    names = [c.split()[0].strip() for c in _columns(schema)]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable", na_position="first")
        out = fold(pdf.astype(object).where(pdf.notna(), None).to_dict("records"))
        return pd.DataFrame([{by: key[0]} | r for r in out], columns=names)

    # keys of a small table would come together in one task
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, by).groupBy(by).applyInPandas(run, schema)


def _columns(schema: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[at:i].strip())
            at = i + 1
    return out + [schema[at:].strip()]


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def temporal_groups(similarity: float, gap: float, distance: float) -> Callable[[list[dict]], list[dict]]:
    """Online grouping of screen texts in order of time: each joins the group with the best ratio to its winner, near enough in time
    and place.  A group closes when its last text is further back than the gap."""

    def fold(rows: list[dict]) -> list[dict]:
        groups: list[dict] = []
        made = 0
        out = []
        for r in rows:
            best, score = None, 0.0
            groups = [g for g in groups if r["t"] - g["t"] <= gap]
            for g in groups:
                if ((r["x"] - g["x"]) ** 2 + (r["y"] - g["y"]) ** 2) ** 0.5 <= distance:
                    q = ratio_from(r["text"], g["winner"], similarity)
                    if q is not None and q > score:
                        best, score = g, q
            if best is None:
                made += 1
                best = {"id": made, "counts": {}}
                groups.append(best)
            c = best["counts"]
            c[r["text"]] = c.get(r["text"], 0) + 1
            best |= {"t": r["t"], "x": r["x"], "y": r["y"], "winner": max(c, key=lambda k: (c[k], len(k)))}
            out.append({"row": r["row"], "grp": best["id"]})
        return out

    return fold


def keep_better(similarity: float) -> Callable[[list[dict]], list[dict]]:
    """Rows near an earlier kept one replace it if their quality is better, and are dropped otherwise."""

    def fold(rows: list[dict]) -> list[dict]:
        kept: list[dict] = []
        for r in rows:
            near = next((k for k, q in enumerate(kept) if ratio(q["text"], r["text"]) > similarity), None)
            if near is None:
                kept.append(r)
            elif r["quality"] > kept[near]["quality"]:
                kept[near] = r
        return [{"row": r["row"], "text": r["text"], "quality": r["quality"]} for r in kept]

    return fold


def recent_collapse(similarity: float, back: int = 12) -> Callable[[list[dict]], list[dict]]:
    """Rows equal to any kept one, or near one of the last back kept, are dropped."""

    def fold(rows: list[dict]) -> list[dict]:
        seen, kept = set(), []
        for r in rows:
            if r["text"] in seen or any(ratio_from(k["text"], r["text"], similarity) is not None for k in kept[-back:]):
                continue
            seen.add(r["text"])
            kept.append(r)
        return [{"row": r["row"], "text": r["text"]} for r in kept]

    return fold


def budgeted_prefix(least: float, target: float, budget: float) -> Callable[[list[dict]], list[dict]]:
    """Each interval cut to target and to what is left of the budget, until less than least is left."""

    def fold(rows: list[dict]) -> list[dict]:
        out, left = [], budget
        for r in rows:
            if left < least:
                break
            d = min(r["e"] - r["s"], target, left)
            if d >= least:
                out.append({"s": round(r["s"], 3), "e": round(min(r["e"], r["s"] + d), 3)})
                left -= d
        return out

    return fold


def fold_in_order(state: dict, step: Callable[[dict, dict], tuple[dict, list[dict]]]) -> Callable[[list[dict]], list[dict]]:
    """Rows folded into a state, with what each step emits; the streaming twin is streaming.state.stateful."""

    def fold(rows: list[dict]) -> list[dict]:
        now, out = dict(state), []
        for r in rows:
            now, events = step(now, r)
            out += events
        return out

    return fold
