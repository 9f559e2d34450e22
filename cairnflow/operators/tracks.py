"""Boxes of text linked to tracks, frame by frame, recordings in segments that are tracked at once.

A box scores against a track by where the track's smoothed velocity foresees it, by spelling, by overlap and by the pause since
it was last seen; pairs are taken best first, each track and box once.  A track closes when its pause is longer than any box may
bridge, so a frame is compared with the few tracks that are open, not with all that were ever made; the scores of a frame are one
array, and spellings are compared only where the other terms and their lengths leave the least score in reach.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .graphs import roots


# Weights of place, spelling, overlap and pause, and the gates and sizes of a link.
@dataclass(frozen=True)
class TrackRules:
    weights: tuple[float, float, float, float] = (0.40, 0.32, 0.18, 0.10)
    max_gap: int = 5
    velocity_ema: float = 0.70
    min_confidence: float = 0.40
    min_text: float = 0.55
    strong_text: float = 0.82
    min_score: float = 0.56
    first_radius: float = 90.0
    velocity_margin: float = 1.5
    slow: float = 2.0
    slow_place: float = 0.35
    least_overlap: float = 0.20
    least_place: float = 0.22


@lru_cache(maxsize=1 << 14)
def spelling_ratio(a: str, b: str) -> float:
    return 1.0 if a == b and a else SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of boxes (x, y, w, h) of a with those of b, all pairs."""
    side = [np.maximum(0.0, np.minimum.outer(a[:, k] + a[:, k + 2], b[:, k] + b[:, k + 2]) - np.maximum.outer(a[:, k], b[:, k])) for k in (0, 1)]
    inter = side[0] * side[1]
    union = np.add.outer(a[:, 2] * a[:, 3], b[:, 2] * b[:, 3]) - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


class Open:
    """The open tracks: a row each of (number, boxes seen, last frame), last box, velocity and spelling."""

    def __init__(self):
        self.keys, self.box, self.v, self.text = np.zeros((0, 3), dtype=np.int64), np.zeros((0, 4)), np.zeros((0, 2)), []

    def close(self, frame: int, most: int) -> None:
        stay = frame - self.keys[:, 2] <= most
        if not stay.all():
            self.keys, self.box, self.v, self.text = self.keys[stay], self.box[stay], self.v[stay], [t for t, s in zip(self.text, stay) if s]

    def see(self, k: int, frame: int, box: np.ndarray, text: str, ema: float) -> None:
        v = (box[:2] + box[2:] / 2 - self.box[k, :2] - self.box[k, 2:] / 2) / max(1, frame - self.keys[k, 2])
        self.v[k] = v if self.keys[k, 1] == 1 else ema * v + (1 - ema) * self.v[k]
        self.keys[k, 1:] = self.keys[k, 1] + 1, frame
        self.box[k], self.text[k] = box, text or self.text[k]

    def start(self, number: int, frame: int, box: np.ndarray, text: str) -> None:
        self.keys = np.vstack([self.keys, [[number, 1, frame]]])
        self.box, self.v = np.vstack([self.box, box]), np.vstack([self.v, [[0.0, 0.0]]])
        self.text.append(text)


#: Pairs of tracks and boxes up to which a frame is scored pair by pair, as arrays of so few cost more than they save.
FEW = 32


def _few_scores(tracks: Open, frame: int, boxes: np.ndarray, texts: list[str], height: float, r: TrackRules) -> np.ndarray:
    """``scores`` of finite boxes, pair by pair, by the same steps."""
    out = np.zeros((len(tracks.text), len(boxes)))
    base = max(5.0, 0.005 * height)
    wp, wt, wo, wg = r.weights
    now = boxes.tolist()
    for i, ((_, n, last), (x, y, w, h), (vx, vy), a) in enumerate(zip(tracks.keys.tolist(), tracks.box.tolist(), tracks.v.tolist(), tracks.text)):
        gap = max(1, frame - last)
        if gap > r.max_gap:
            continue
        speed = float(np.hypot(vx, vy))
        radius = max(r.first_radius, base + 2.0 * max(w, h)) if n <= 1 else base + speed * r.velocity_margin
        x, y = x + vx * gap, y + vy * gap
        pause = 1 - min(1.0, (gap - 1) / max(r.max_gap, 1))
        slow = speed < r.slow and n >= 2
        for j, (p, q, u, g) in enumerate(now):
            far = float(np.hypot((x + w / 2) - (p + u / 2), (y + h / 2) - (q + g / 2)))
            place = 1 - min(1.0, far / max(1.0, radius + max(1.0, w, h, u, g)))
            inter = max(0.0, min(x + w, p + u) - max(x, p)) * max(0.0, min(y + h, q + g) - max(y, q))
            union = w * h + u * g - inter
            shared = inter / union if union > 0 else 0.0
            rest = wp * place + wo * shared + wg * pause
            if rest + wt < r.min_score or (slow and place < r.slow_place):
                continue
            b = texts[j]
            if rest + wt * (2 * min(len(a), len(b)) / max(1, len(a) + len(b))) < r.min_score:
                continue
            t = spelling_ratio(a, b)
            if t >= r.min_text if slow else (t >= r.min_text or shared >= r.least_overlap) and (place >= r.least_place or t >= r.strong_text):
                out[i, j] = rest + wt * t
    return out


def scores(tracks: Open, frame: int, boxes: np.ndarray, texts: list[str], height: float, r: TrackRules) -> np.ndarray:
    """The score of each track with each box of a frame; nothing where a gate fails or the least score is out of reach."""
    if len(tracks.text) * len(boxes) <= FEW and np.isfinite(boxes).all() and np.isfinite(tracks.box).all() and np.isfinite(tracks.v).all():
        return _few_scores(tracks, frame, boxes, texts, height, r)
    gap = np.maximum(1, frame - tracks.keys[:, 2])
    seen = np.concatenate([tracks.box[:, :2] + tracks.v * gap[:, None], tracks.box[:, 2:]], axis=1)
    speed = np.hypot(tracks.v[:, 0], tracks.v[:, 1])
    base = max(5.0, 0.005 * height)
    radius = np.where(tracks.keys[:, 1] <= 1, np.maximum(r.first_radius, base + 2.0 * tracks.box[:, 2:].max(axis=1)), base + speed * r.velocity_margin)
    far = [np.subtract.outer(seen[:, k] + seen[:, k + 2] / 2, boxes[:, k] + boxes[:, k + 2] / 2) for k in (0, 1)]
    scale = np.maximum(1.0, np.maximum.outer(seen[:, 2:].max(axis=1), boxes[:, 2:].max(axis=1)))
    place = 1 - np.minimum(1.0, np.hypot(*far) / np.maximum(1.0, radius[:, None] + scale))
    shared = overlap(seen, boxes)
    pause = 1 - np.minimum(1.0, (gap - 1) / max(r.max_gap, 1))
    wp, wt, wo, wg = r.weights
    rest = wp * place + wo * shared + wg * pause[:, None]
    slow = (speed < r.slow) & (tracks.keys[:, 1] >= 2)
    out = np.zeros_like(rest)
    for i, j in zip(*np.nonzero((rest + wt >= r.min_score) & ~(slow[:, None] & (place < r.slow_place)) & (gap <= r.max_gap)[:, None])):
        a, b = tracks.text[i], texts[j]
        most = 2 * min(len(a), len(b)) / max(1, len(a) + len(b))
        if rest[i, j] + wt * most < r.min_score:
            continue
        t = spelling_ratio(a, b)
        fits = t >= r.min_text if slow[i] else (t >= r.min_text or shared[i, j] >= r.least_overlap) and (place[i, j] >= r.least_place or t >= r.strong_text)
        if fits:
            out[i, j] = rest[i, j] + wt * t
    return out


def _frames(rows: list[dict], r: TrackRules) -> Iterator[tuple[int, list[dict]]]:
    """Frames in order, with the boxes that can be linked from top to bottom."""
    ok = [x for x in rows if x["text"] and x["w"] and x["h"] and x["w"] > 0 and x["h"] > 0 and (x.get("confidence") is None or x["confidence"] >= r.min_confidence)]
    for t, part in groupby(sorted(ok, key=lambda x: x["t"]), key=lambda x: x["t"]):
        yield int(t), sorted(part, key=lambda x: (x["y"] + x["h"] / 2, x["x"] + x["w"] / 2, x["row"]))


class Walk:
    """Goes over frames with the open tracks.  ``tied`` tells whether pairs of equal scores were met, so that the order of tracks mattered."""

    def __init__(self, tracks: Open, tall: float, rules: TrackRules):
        self.tracks, self.tall, self.rules, self.made, self.tied = tracks, tall, rules, 0, False

    def frame(self, at: int, boxes: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The track's number, and its velocity after it, of each box of a frame."""
        tracks, rules = self.tracks, self.rules
        tracks.close(at, rules.max_gap)
        found = scores(tracks, at, boxes, texts, self.tall, rules)
        # best first; of equal scores the later track, then the later box
        free_t, free_b, of = np.ones(len(tracks.text), dtype=bool), np.ones(len(boxes), dtype=bool), {}
        pairs = sorted(((found[i, j], i, j) for i, j in zip(*np.nonzero(found >= rules.min_score))), reverse=True)
        self.tied |= len({q for q, _, _ in pairs}) < len(pairs)
        for _, i, j in pairs:
            if free_t[i] and free_b[j]:
                free_t[i] = free_b[j] = False
                of[j] = i
        for j, i in of.items():
            tracks.see(i, at, boxes[j], texts[j], rules.velocity_ema)
        for j in np.flatnonzero(free_b):
            of[j] = len(tracks.text)
            tracks.start(self.made, at, boxes[j], texts[j])
            self.made += 1
        which = np.array([of[j] for j in range(len(boxes))], dtype=np.int64)
        return tracks.keys[which, 0], tracks.v[which]


def track_boxes(rules: TrackRules = TrackRules(), height: float | None = None) -> Callable[[list[dict]], list[dict]]:
    """Rows (row, t: frame, x, y, w, h, text: screen_text, confidence) to (row, track, vx, vy): the track of each box that can be
    linked, numbered as they begin, and its velocity after it.  One recording at a time; ``track_segments`` does the same for
    recordings of any length."""

    def fold(rows: list[dict]) -> list[dict]:
        out = []
        walk = Walk(Open(), height or max([1.0, *(x["y"] + x["h"] for x in rows if x["h"])]), rules)
        for frame, now in _frames(rows, rules):
            track, v = walk.frame(frame, np.array([[x["x"], x["y"], x["w"], x["h"]] for x in now], dtype=float), [x["text"] for x in now])
            out += [{"row": x["row"], "track": int(track[j]), "vx": float(v[j, 0]), "vy": float(v[j, 1])} for j, x in enumerate(now)]
        return out

    return fold


def dump(tracks: Open) -> list[list]:
    """The open tracks without their numbers; beyond the second it doesn't matter how many boxes a track has seen."""
    return [[int(k[2]), min(int(k[1]), 2), *map(float, b), *map(float, v), t] for k, b, v, t in zip(tracks.keys, tracks.box, tracks.v, tracks.text)]


def load(rows: list[list]) -> Open:
    """Open tracks with the numbers -1, -2, ... by place."""
    out = Open()
    if rows:
        out.keys = np.array([[-1 - k, r[1], r[0]] for k, r in enumerate(rows)], dtype=np.int64)
        out.box, out.v, out.text = np.array([r[2:6] for r in rows], dtype=float), np.array([r[6:8] for r in rows], dtype=float), [r[8] for r in rows]
    return out


def hand_over(left: list[list], assumed: list[list], frame: int, tied: bool, rules: TrackRules) -> list[int] | None:
    """Which of the tracks that a segment left open each of those is that the next one assumed, from its first frame on; None if it assumed
    others, or in another order where that mattered."""
    stay = [k for k, r in enumerate(left) if frame - r[0] <= rules.max_gap]
    if len(stay) != len(assumed):
        return None
    if all(left[k] == r for k, r in zip(stay, assumed)):
        return stay
    a, b = sorted(stay, key=lambda k: left[k]), sorted(range(len(assumed)), key=lambda k: assumed[k])
    alike = any(left[x] == left[y] for x, y in zip(a, a[1:]))
    if tied or alike or any(left[x] != assumed[y] for x, y in zip(a, b)):
        return None
    return [x for _, x in sorted(zip(b, a))]


_DONE = "by {by}, seg long, row {row}, track long, vx double, vy double, f0 long, births long, tied boolean, assumed string, left string"


def _tracked(rules: TrackRules) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A segment's boxes, and one row of what it assumed to be open at its first frame and what it left open.  It starts from the tracks
    that are given, or else from those that the frames before it give, taken from nothing."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        boxes = np.stack([pdf[c].to_numpy(dtype=float) for c in ("x", "y", "w", "h")], axis=1)
        row, place = pdf["row"], pdf["row"]
        if row.dtype.kind not in "iuf":
            place, values = pd.factorize(row, sort=True)
            place = np.where(place < 0, len(values), place)
        order = np.lexsort((place, boxes[:, 0] + boxes[:, 2] / 2, boxes[:, 1] + boxes[:, 3] / 2, pdf["t"].to_numpy()))
        boxes, row = boxes[order], row.to_numpy()[order]
        t, ahead, texts = pdf["t"].to_numpy()[order], pdf["warm"].to_numpy()[order], pdf["text"].to_numpy()[order].tolist()
        given, tall = pdf["given"].iloc[0], float(pdf["tall"].iloc[0])
        given = given if isinstance(given, str) else None
        own = np.flatnonzero(~ahead)
        f0 = int(t[own[0]])
        walk = Walk(Open(), tall, rules)
        for frame, at in _by_frame(t, np.flatnonzero(ahead) if given is None else own[:0]):
            walk.frame(frame, boxes[at], [texts[k] for k in at])
        walk.tracks.close(f0, rules.max_gap)
        assumed = dump(walk.tracks) if given is None else json.loads(given)
        walk = Walk(load(assumed), tall, rules)
        track, v = [], []
        for frame, at in _by_frame(t, own):
            now = walk.frame(frame, boxes[at], [texts[k] for k in at])
            track.append(now[0])
            v.append(now[1])
        left = [[*r, int(k)] for r, k in zip(dump(walk.tracks), walk.tracks.keys[:, 0])]
        n = len(own)
        track, v = np.concatenate(track), np.concatenate(v)
        none = [None] * n
        out = {"by": [pdf["by"].iloc[0]] * (n + 1), "seg": [pdf["seg"].iloc[0]] * (n + 1)}
        out |= {c: [*x.tolist(), None] for c, x in (("row", row[own]), ("track", track), ("vx", v[:, 0]), ("vy", v[:, 1]))}
        # the last row is the segment's own
        return pd.DataFrame(out | {"f0": [*none, f0], "births": [*none, walk.made], "tied": [*none, walk.tied], "assumed": [*none, json.dumps(assumed)], "left": [*none, json.dumps(left)]})

    return run


def _by_frame(t: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Frames of rows that are in their order, with the rows of each."""
    now = t[rows]
    cuts = np.flatnonzero(np.r_[True, now[1:] != now[:-1]]) if len(now) else []
    for lo, hi in zip(cuts, [*cuts[1:], len(now)]):
        yield int(now[lo]), rows[lo:hi]


def _checked(rules: TrackRules) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Of each segment with what the one before it left: whether it assumed that, the tracks to start from if not, and its links: its
    k-th open track is a birth (from 0) of the segment before, or that one's own open track (-1, -2, ...)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for by, seg, before, f0, tied, assumed, left in zip(*(pdf[c] for c in ("by", "seg", "before", "f0", "tied", "assumed", "left_before"))):
                was = json.loads(left) if isinstance(left, str) else []
                bare = [r[:-1] for r in was]
                of = hand_over(bare, json.loads(assumed), int(f0), bool(tied), rules)
                given = None if of is not None else json.dumps([r for r in bare if f0 - r[0] <= rules.max_gap])
                rows.append((by, seg, before, given, [] if of is None else [was[k][-1] for k in of]))
            yield pd.DataFrame(rows, columns=["by", "seg", "before", "given", "links"]).astype({"before": "Int64"})

    return run


def track_segments(rows: DataFrame, by: str, rules: TrackRules = TrackRules(), frames: int = 512, warm: int = 64, height: float | None = None) -> DataFrame:
    """``track_boxes`` for recordings (by) of any length: by, row, track, vx, vy, the same at any cut.

    A recording is cut in segments of so many frames, which are tracked at once, each after ``warm`` frames of the one before,
    as tracks forget: one that closes is gone, and a velocity is a moving mean.  Then what each segment left open is held against what
    the next one assumed, and those that assumed something else are tracked again from what they were given, until none is left.
    Open tracks are handed over by place; a track that crosses segments is followed back to the one that it began in by
    doubling steps, and tracks are numbered through by how many began before.

    A null by is a recording of its own; rows with a null frame are left out, as are boxes that can't be linked.
    """
    tall = rows.where("h <> 0").groupBy(F.col(by).alias("by")).agg(F.greatest(F.lit(1.0), F.max(F.col("y") + F.col("h"))).alias("tall"))
    fits = "text <> '' AND w > 0 AND h > 0 AND t IS NOT NULL" + (f" AND (confidence IS NULL OR confidence >= {rules.min_confidence})" if "confidence" in rows.columns else "")
    boxes = rows.where(fits).select(F.col(by).alias("by"), "row", F.col("t").cast("long").alias("t"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")], "text")
    seg = F.floor(F.col("t") / frames)
    here = F.struct(seg.alias("seg"), F.lit(False).alias("warm"))
    ahead = F.struct((seg + 1).alias("seg"), F.lit(True).alias("warm"))
    dealt = boxes.select("*", F.inline(F.when(F.col("t") >= (seg + 1) * frames - warm, F.array(here, ahead)).otherwise(F.array(here))))
    dealt = (dealt.withColumn("tall", F.lit(float(height))) if height else dealt.join(tall, dealt["by"].eqNullSafe(tall["by"])).drop(tall["by"])).withColumn("given", F.lit(None).cast("string"))
    # a segment without boxes of its own has nothing to track
    dealt = written(dealt, "segments")
    dealt = dealt.join(dealt.where("NOT warm").select(F.col("by").alias("_b"), F.col("seg").alias("_s")).distinct(), F.col("by").eqNullSafe(F.col("_b")) & (F.col("seg") == F.col("_s")), "left_semi")
    schema = _DONE.format(by=boxes.schema["by"].dataType.simpleString(), row=boxes.schema["row"].dataType.simpleString())
    # segments of a small table would come together in few tasks
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tracked = lambda d: d.repartition(tasks, "by", "seg").groupBy("by", "seg").applyInPandas(_tracked(rules), schema)
    done = written(tracked(dealt), "tracked").withColumn("round", F.lit(0))
    w = Window.partitionBy("by").orderBy("seg")
    for k in range(1, 1 << 20):
        last = done.where("f0 IS NOT NULL").groupBy("by", "seg").agg(F.max_by(F.struct("f0", "births", "tied", "assumed", "left", "round"), "round").alias("s")).select("by", "seg", "s.*")
        last = written(last.withColumns({"before": F.lag("seg").over(w), "left_before": F.lag("left").over(w), "first": F.coalesce(F.sum("births").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}), "left")
        facts = written(last.select("by", "seg", "before", "f0", "tied", "assumed", "left_before").mapInPandas(_checked(rules), f"by {boxes.schema['by'].dataType.simpleString()}, seg long, before long, given string, links array<long>"), "checked")
        wrong = facts.where("given IS NOT NULL").select(F.col("by").alias("_b"), F.col("seg").alias("_s"), F.col("given").alias("start"))
        if wrong.isEmpty():
            break
        again = dealt.where("NOT warm").join(wrong, F.col("by").eqNullSafe(F.col("_b")) & (F.col("seg") == F.col("_s"))).withColumn("given", F.col("start")).select(dealt.columns)
        done = done.unionByName(written(tracked(again), "tracked").withColumn("round", F.lit(k)))
    links = facts.select("by", "seg", "before", F.posexplode("links").alias("k", "of"))
    node = lambda s, n: F.concat_ws(":", s, n)
    # a recording's nodes: births of a segment, and its open tracks; by is kept apart as it may be of any type
    parents = links.select(F.struct(F.col("by").alias("b"), node("seg", -1 - F.col("k")).alias("n")).alias("node"), F.struct(F.col("by").alias("b"), node("before", F.col("of")).alias("n")).alias("parent"))
    began = roots(parents).select(F.col("node.b").alias("_b"), F.col("node.n").alias("_n"), F.col("root.n").alias("began"))
    out = done.where("f0 IS NULL").join(last.select(F.col("by").alias("_lb"), F.col("seg").alias("_ls"), F.col("round").alias("_lr")), F.col("by").eqNullSafe(F.col("_lb")) & (F.col("seg") == F.col("_ls")) & (F.col("round") == F.col("_lr")), "left_semi")
    out = out.withColumn("n", node("seg", "track")).join(began, F.col("by").eqNullSafe(F.col("_b")) & (F.col("n") == F.col("_n")), "left")
    start = F.split(F.coalesce("began", "n"), ":")
    out = out.select("by", "row", "vx", "vy", start[0].cast("long").alias("seg"), start[1].cast("long").alias("birth"))
    first = last.select(F.col("by").alias("_b"), F.col("seg").alias("_s"), "first")
    out = out.join(first, F.col("by").eqNullSafe(F.col("_b")) & (F.col("seg") == F.col("_s")))
    return out.select(F.col("by").alias(by), "row", (F.col("first") + F.col("birth")).cast("int").alias("track"), "vx", "vy")
