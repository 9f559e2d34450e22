"""What two or more readers made of one thing, put together: sequences of lines, readings of one line, tracks of one text."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from difflib import SequenceMatcher
from functools import lru_cache

from ..functions import names as N

# The letters that a word of four or more has one of.
VOWELS = frozenset("aeiou")


@lru_cache(maxsize=1 << 14)
def _folded(text: str) -> tuple[str, list[str]]:
    """A text's fold and its words, which are asked for with each other text."""
    x = N.fold(text)
    return x, x.split()


def _near(least: float) -> Callable[[str, str], bool]:
    """As many words, the first one equal, and a ratio of at least so much."""

    def near(a: str, b: str) -> bool:
        (x, u), (y, v) = _folded(a), _folded(b)
        if not x or not y:
            return False
        return x == y or len(u) == len(v) and u[0] == v[0] and N.ratio_at_least(x, y, least)

    return near


def marks(text: str) -> int:
    """Letters with marks of their own."""
    return sum(c.isalpha() and ord(c) > 127 for c in text)


def merge_readers(known: dict[str, str] | None = None, least: float = 0.86) -> Callable[[list[dict]], list[dict]]:
    """Two readers' lines (rows reader: a or b, pos, text in order) as one sequence (text, source).

    Equal folded lines agree; of a stretch that both read differently each line of a takes the first near line of b that is free,
    and the known spelling, or the one with more marks, or the longer one, stands for both; what one alone read stays in its place.
    At last lines near an earlier one go, and leave it their spelling if that has more marks.  Source: both, a, b, known or marks."""
    near, known = _near(least), known or {}

    def pick(a: str, b: str) -> tuple[str, str]:
        for s in (a, b):
            if N.fold(s) in known and sum(any(c.isalpha() for c in w) for w in s.split()) >= 2:
                return known[N.fold(s)], "known"
        return max((a, b), key=lambda s: (marks(s), len(s))), "marks"

    def alone(s: str, source: str) -> tuple[str, str]:
        two = sum(any(c.isalpha() for c in w) for w in s.split()) >= 2
        return (known[N.fold(s)] if two and N.fold(s) in known else s), source

    def fold(rows: list[dict]) -> list[dict]:
        a, b = ([r["text"] for r in rows if r["reader"] == k and (r["text"] or "").strip()] for k in "ab")
        merged: list[tuple[str, str]] = []
        for kind, i, j, k, m in SequenceMatcher(None, [N.fold(s) for s in a], [N.fold(s) for s in b], autojunk=False).get_opcodes():
            if kind == "equal":
                merged += [alone(s, "both") for s in a[i:j]]
                continue
            free = dict(enumerate(b[k:m]))
            for s in a[i:j]:
                other = next((q for q, t in free.items() if near(s, t)), None)
                merged.append(alone(s, "a") if other is None else pick(s, free.pop(other)))
            merged += [alone(t, "b") for t in free.values()]
        out: list[dict] = []
        for s, source in merged:
            was = next((r for r in out if near(r["text"], s)), None)
            if was is None:
                out.append({"text": s, "source": source})
            elif marks(s) > marks(was["text"]):
                was["text"] = s
        return [{"pos": n} | r for n, r in enumerate(out)]

    return fold


def garble(text: str) -> float:
    """How much of a reading isn't letters, and a point for each word of four letters or more without a vowel; 9 for nothing."""
    solid = [c for c in text if not c.isspace()]
    if not solid:
        return 9.0
    plain = lambda w: "".join(c for c in unicodedata.normalize("NFKD", w.lower()) if not unicodedata.combining(c))
    return (1 - sum(map(str.isalpha, solid)) / len(solid)) * 2.0 + sum(len(w) >= 4 and not VOWELS & set(w) for w in map(plain, text.split()))


def reading_mode(least: float = 0.80) -> Callable[[list[dict]], list[dict]]:
    """The fuzzy mode of readings (rows text in order): each joins the first group whose first member it is near; the largest group,
    the first of equals, gives its cleanest and then longest member, with its share of all readings."""

    def fold(rows: list[dict]) -> list[dict]:
        plain = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))
        groups: list[tuple[str, list[str]]] = []
        texts = [r["text"] for r in rows if r["text"] is not None]
        for s in texts:
            p = plain(s)
            mine = next((g for g in groups if N.ratio_at_least(p, g[0], least)), None)
            if mine is None:
                groups.append((p, [s]))
            else:
                mine[1].append(s)
        if not groups:
            return []
        top = max(groups, key=lambda g: len(g[1]))[1]
        return [{"text": min(top, key=lambda s: (garble(s), -len(s))), "confidence": len(top) / len(texts), "n": len(top)}]

    return fold


def track_dedup(least: float = 0.80, shared_chars: int = 4) -> Callable[[list[dict]], list[dict]]:
    """Tracks of one text (rows row, text, n, confidence, frame, y, h in order) kept once: one joins the first kept track that it is
    near by ratio, by whole words or the end of a word (from three letters on), or by standing at the same height of the same frame;
    of both the one with the longer text or the better (confidence times the root of its sightings) stays, the newer one first."""

    def same(a: dict, b: dict, x: str, y: str) -> bool:
        if N.ratio_at_least(x, y, least):
            return True
        if min(len(x), len(y)) >= 3 and (N.whole_words(x, y) or N.suffix_token(x, y, shared_chars)):
            return True
        return a["frame"] is not None and a["frame"] == b["frame"] and min(a["y"] + a["h"], b["y"] + b["h"]) > max(a["y"], b["y"])

    def fold(rows: list[dict]) -> list[dict]:
        kept: list[tuple[dict, str]] = []
        worth = lambda r: r["confidence"] * r["n"] ** 0.5
        for r in rows:
            x = N.fold(r["text"])
            k = next((k for k, (q, y) in enumerate(kept) if same(q, r, y, x)), None)
            if k is None:
                kept.append((r, x))
            elif worth(r) > worth(kept[k][0]) or len(x) > len(kept[k][1]):
                kept[k] = r, x
        return [{"row": r["row"], "text": r["text"]} for r, _ in kept]

    return fold
