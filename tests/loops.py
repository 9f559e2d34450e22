"""Loops over one key's rows in order, all pairs at a time: what the operators in rounds are held against."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from cairnflow.functions import names as N
from cairnflow.operators.folds import ratio
from cairnflow.operators.readers import _near, marks
from cairnflow.operators.rosters import same_person

Near = Callable[[str, str], bool]


def variant_merge(similarity: float) -> Callable[[list[dict]], list[dict]]:
    """Spellings by falling count: each joins the first kept one of as many tokens that it is near, and counts for it."""

    def fold(rows: list[dict]) -> list[dict]:
        kept: list[dict] = []
        for r in rows:
            hit = next((k for k in kept if len(k["text"].split()) == len(r["text"].split()) and ratio(r["text"], k["text"]) >= similarity), None)
            if hit:
                hit["n"] += r["n"]
            else:
                kept.append({"text": r["text"], "n": r["n"]})
        return kept

    return fold


def greedy_matching(threshold: float) -> Callable[[list[dict]], list[dict]]:
    """One-to-one matching of candidates and truth by falling similarity; rows have side ('c' or 't') and text."""

    def fold(rows: list[dict]) -> list[dict]:
        sides = {s: list(dict.fromkeys(r["text"] for r in rows if r["side"] == s)) for s in "ct"}
        pairs = sorted(((q, c, t) for c in sides["c"] for t in sides["t"] if (q := ratio(c, t)) >= threshold), reverse=True)
        used: set[tuple[str, str]] = set()
        n = 0
        for _, c, t in pairs:
            if ("c", c) not in used and ("t", t) not in used:
                used |= {("c", c), ("t", t)}
                n += 1
        p, r = (n / len(sides["c"]) if sides["c"] else 0.0), (n / len(sides["t"]) if sides["t"] else 0.0)
        return [{"tp": n, "fp": len(sides["c"]) - n, "fn": len(sides["t"]) - n, "precision": round(p, 4), "recall": round(r, 4), "f1": round(2 * p * r / (p + r), 4) if p + r else 0.0}]

    return fold


def transitive_clusters(similarity: float, length: float = 0.6) -> Callable[[list[dict]], list[dict]]:
    """Clusters by chains of near texts, each as its most confident text, without those that are most of a longer one."""

    def fold(rows: list[dict]) -> list[dict]:
        parent = list(range(len(rows)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i, a in enumerate(rows):
            for j in range(i + 1, len(rows)):
                m, n = len(a["text"]), len(rows[j]["text"])
                if min(m, n) >= length * max(m, n) and root(i) != root(j) and ratio(a["text"], rows[j]["text"]) >= similarity:
                    parent[root(j)] = root(i)
        best: dict[int, dict] = {}
        for i, r in enumerate(rows):
            k = root(i)
            if k not in best or r["confidence"] > best[k]["confidence"]:
                best[k] = r
        keep = [r for r in best.values() if len(r["text"]) < 3 or not any(length * len(q["text"]) <= len(r["text"]) < len(q["text"]) and r["text"] in q["text"] for q in best.values())]
        return [{"row": r["row"], "text": r["text"]} for r in keep]

    return fold


def clone_collapse(similarity: float) -> Callable[[list[dict]], list[dict]]:
    """Of two near names of as many tokens the one without evidence goes; of two with evidence, neither known, the weaker one."""

    def fold(rows: list[dict]) -> list[dict]:
        gone: set[int] = set()
        for i, a in enumerate(rows):
            for j in range(i + 1, len(rows)):
                b = rows[j]
                if i in gone or j in gone or len(a["text"].split()) != len(b["text"].split()) or ratio(a["text"], b["text"]) < similarity:
                    continue
                if bool(a["evidence"]) != bool(b["evidence"]):
                    gone.add(j if a["evidence"] else i)
                elif a["evidence"] and not a["known"] and not b["known"]:
                    gone.add(j if a["evidence"] >= b["evidence"] else i)
        return [{"row": r["row"], "text": r["text"]} for k, r in enumerate(rows) if k not in gone]

    return fold


def spelling_groups(known: dict[str, str] | None = None, least: float = 0.86) -> Callable[[list[dict]], list[dict]]:
    """Near spellings (rows text, n in order) by any member: each joins the first group that has one near it; of a group the known
    spelling, or the one of most marks, then count, then length, stands for all, with the sum of their counts."""
    near, known = _near(least), known or {}

    def fold(rows: list[dict]) -> list[dict]:
        groups: list[list[dict]] = []
        for r in rows:
            mine = next((g for g in groups if any(near(m["text"], r["text"]) for m in g)), None)
            if mine is None:
                groups.append([r])
            else:
                mine.append(r)
        best = lambda g: next((known[N.fold(r["text"])] for r in g if N.fold(r["text"]) in known), None) or max(g, key=lambda r: (marks(r["text"]), r["n"], len(r["text"])))["text"]
        return [{"text": best(g), "n": sum(r["n"] for r in g), "members": len(g)} for g in groups]

    return fold


@dataclass
class Cluster:
    first: int
    names: list[str]
    episodes: set = field(default_factory=set)


class _Index:
    """Finds the earlier spellings that may be near a new one: all that ``same_person`` accepts share a token of over two letters,
    or are single tokens of about one length."""

    def __init__(self):
        self.by_token: dict[str, list[int]] = defaultdict(list)
        self.single: dict[int, list[int]] = defaultdict(list)

    def add(self, k: int, name: str) -> Iterable[int]:
        tokens = N.long_tokens(name)
        found = {j for t in tokens for j in self.by_token[t]}
        if len(tokens) == 1:
            found |= {j for n in range(len(tokens[0]) - 2, len(tokens[0]) + 3) for j in self.single[n]}
            self.single[len(tokens[0])].append(k)
        for t in set(tokens):
            self.by_token[t].append(k)
        return sorted(found)


def spelling_clusters(near: Near | None = None) -> Callable[[list[dict]], list[dict]]:
    """Clusters of spellings (rows episode, text in order).  A spelling met for the first time asks each earlier one that is near it
    to join, in their order; clusters seen in one episode are two people and stay apart, and a refusal isn't asked again.  Without
    ``near`` spellings are near by ``same_person`` after academic titles are taken off, and only those that share a token are
    compared.  A row for each spelling: text, cluster (the number of its first spelling), n (its episodes)."""

    def fold(rows: list[dict]) -> list[dict]:
        order: list[str] = []
        of: dict[str, Cluster] = {}
        seen: dict[str, set] = {}
        index = _Index()
        for r in rows:
            name = (r["text"] or "").strip()
            if not name:
                continue
            if fresh := name not in of:
                of[name], seen[name] = Cluster(len(order), [name]), set()
                order.append(name)
            seen[name].add(r["episode"])
            of[name].episodes.add(r["episode"])
            if fresh:
                bare = N.untitled(name)
                earlier = index.add(len(order) - 1, bare) if near is None else range(len(order) - 1)
                for j in earlier:
                    if (near or same_person)(N.untitled(order[j]) if near is None else order[j], bare if near is None else name):
                        _join(of, order[j], name)
        return [{"text": n, "cluster": of[n].first, "n": len(seen[n])} for n in order]

    return fold


def _join(of: dict[str, Cluster], a: str, b: str) -> None:
    x, y = sorted((of[a], of[b]), key=lambda c: c.first)
    if x is not y and x.episodes.isdisjoint(y.episodes):
        x.names += y.names
        x.episodes |= y.episodes
        for n in y.names:
            of[n] = x


def capped_merge(max_seconds: float, gap: float) -> Callable[[list[dict]], list[dict]]:
    """Intervals (s, e) joined while the pause is at most gap and the whole at most max_seconds."""

    def fold(rows: list[dict]) -> list[dict]:
        out: list[dict] = []
        for r in rows:
            if out and r["s"] - out[-1]["e"] <= gap and r["e"] - out[-1]["s"] <= max_seconds:
                out[-1]["e"], out[-1]["n"] = r["e"], out[-1]["n"] + 1
            else:
                out.append({"s": r["s"], "e": r["e"], "n": 1})
        return [{"chunk": k} | r for k, r in enumerate(out)]

    return fold


def merged_chunks(duration: float, min_seconds: float, max_seconds: float, gap: float, padding: float) -> Callable[[list[dict]], list[dict]]:
    """capped_merge, then short chunks widened into the free time around them, cut at the middle between neighbours, padded."""

    def fold(rows: list[dict]) -> list[dict]:
        groups = [(r["s"], r["e"], r["n"]) for r in capped_merge(max_seconds, gap)(rows)]
        wide = []
        for k, (s, e, n) in enumerate(groups):
            lo = groups[k - 1][1] if k else 0.0
            hi = groups[k + 1][0] if k + 1 < len(groups) else duration
            s, e = max(0.0, min(duration, s)), max(0.0, min(duration, e))
            if e <= s:
                continue
            if (lack := min(min_seconds - (e - s), max(0.0, hi - lo - (e - s)))) > 0:
                before = min(lack / 2, max(0.0, s - lo))
                after = min(lack - before, max(0.0, hi - e))
                before = min(max(0.0, s - lo), before + max(0.0, lack - before - after))
                s, e = max(lo, s - before), min(hi, e + after)
            wide.append((s, e, n))
        cuts = [0.0]
        for (_, e, _), (s, _, _) in zip(wide, wide[1:]):
            cuts.append(max(cuts[-1], min(duration, (e + s) / 2)))
        cuts.append(duration)
        out = []
        for k, (s, e, n) in enumerate(wide):
            s, e = max(cuts[k], s - padding, 0.0), min(cuts[k + 1], e + padding, duration)
            if e - s >= 0.1:
                out.append({"chunk": len(out), "s": round(s, 3), "e": round(e, 3), "n": n})
        return out

    return fold


def merge_windows(gap: float) -> Callable[[list[dict]], list[dict]]:
    """Neighbours of one type within gap are joined; metric is the pairwise mean from the left."""

    def fold(rows: list[dict]) -> list[dict]:
        out: list[dict] = []
        for r in rows:
            if out and out[-1]["type"] == r["type"] and r["s"] - out[-1]["e"] <= gap:
                out[-1]["e"], out[-1]["metric"] = r["e"], (out[-1]["metric"] + r["metric"]) / 2
            else:
                out.append({k: r[k] for k in ("s", "e", "type", "metric")})
        return out

    return fold


def smooth_bridges(unknown: str, seconds: float) -> Callable[[list[dict]], list[dict]]:
    """X, a short unknown, X becomes X; three rows are used up at a time, from the left."""

    def fold(rows: list[dict]) -> list[dict]:
        out, k = [], 0
        while k < len(rows):
            r = {c: rows[k][c] for c in ("s", "e", "type")}
            if k + 2 < len(rows) and r["type"] == rows[k + 2]["type"] and rows[k + 1]["type"] == unknown and rows[k + 1]["e"] - rows[k + 1]["s"] <= seconds:
                r["e"], k = rows[k + 2]["e"], k + 3
            else:
                k += 1
            out.append(r)
        return out

    return fold


def overlap_groups(least: float) -> Callable[[list[dict]], list[dict]]:
    """Rows join the group whose window, grown by its rows, they overlap by at least this share of the shorter one."""

    def fold(rows: list[dict]) -> list[dict]:
        out: list[dict] = []
        for r in rows:
            if out:
                g = out[-1]
                both = max(0.0, min(g["e"], r["e"]) - max(g["s"], r["s"]))
                short = min(g["e"] - g["s"], r["e"] - r["s"])
                if (both / short if short > 0 else float(both > 0)) >= least:
                    g["s"], g["e"], g["n"] = min(g["s"], r["s"]), max(g["e"], r["e"]), g["n"] + 1
                    continue
            out.append({"card": len(out) + 1, "s": r["s"], "e": r["e"], "n": 1})
        return out

    return fold


def anchor_dedup(threshold: int, keep: int) -> Callable[[list[dict]], list[dict]]:
    """Rows whose hash is near the first of their cluster join it; keep evenly spaced ones of each cluster stay."""

    def fold(rows: list[dict]) -> list[dict]:
        if len(rows) <= keep:
            return [{"pos": r["pos"]} for r in rows]
        clusters: list[list[dict]] = []
        for r in rows:
            anchor = clusters[-1][0]["hash"] if clusters else None
            if anchor is not None and r["hash"] is not None and (int(anchor) ^ int(r["hash"])).bit_count() <= threshold:
                clusters[-1].append(r)
            else:
                clusters.append([r])
        out = set()
        for c in clusters:
            n = len(c)
            out |= {r["pos"] for r in c} if n <= keep else {c[0]["pos"]} if keep == 1 else {c[round(t * (n - 1) / (keep - 1))]["pos"] for t in range(keep)}
        return [{"pos": p} for p in sorted(out)]

    return fold


def regimes(unknown: str, tolerance: int, confirm: int) -> Callable[[list[dict]], list[dict]]:
    """Runs of a label over up to tolerance unknown rows between them; those of at least confirm known rows."""

    def fold(rows: list[dict]) -> list[dict]:
        out: list[dict] = []
        blank = 0
        for r in rows:
            if r["label"] == unknown:
                blank += 1
                continue
            if out and out[-1]["label"] == r["label"] and blank <= tolerance:
                out[-1]["last"], out[-1]["n"] = r["pos"], out[-1]["n"] + 1
            else:
                out.append({"label": r["label"], "first": r["pos"], "last": r["pos"], "n": 1})
            blank = 0
        return [r for r in out if r["n"] >= confirm]

    return fold


def onset(label: str, floor: float, unknown: str, missing: str, tolerance: int, confirm: int) -> Callable[[list[dict]], list[dict]]:
    """The decision on where label begins: rows under the confidence floor count as unknown; one confirmed run is FOUND, several are
    REVIEW, none NONE, and rows that are all missing MODEL_ERROR; positions that aren't consecutive are an error."""

    def fold(rows: list[dict]) -> list[dict]:
        if any(b["pos"] - a["pos"] != 1 for a, b in zip(rows, rows[1:])):
            return [{"decision": "GAP", "onset": None}]
        if all(r["label"] == missing for r in rows):
            return [{"decision": "MODEL_ERROR", "onset": None}]
        seen = [r | {"label": unknown if r["confidence"] < floor or r["label"] == missing else r["label"]} for r in rows]
        runs = [r for r in regimes(unknown, tolerance, confirm)(seen) if r["label"] == label]
        if not runs:
            return [{"decision": "NONE", "onset": None}]
        return [{"decision": "FOUND" if len(runs) == 1 else "REVIEW", "onset": runs[0]["first"]}]

    return fold
