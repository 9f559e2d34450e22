"""People over episodes: members matched to what was read, a roster carried from episode to episode.  Spellings are put together by
``rounds.vetoed_clusters`` over ``nearness.near_names``."""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from ..functions import names as N


def same_person(a: str, b: str) -> bool:
    """Whether two spellings, without academic titles, may be one person's."""
    return N.matches(a, b) or N.close(a, b)


def canonical(spellings: dict[str, int], known: Callable[[str], bool] = lambda _: False, garbled: Callable[[str], bool] = lambda _: False) -> str:
    """The spelling that stands for a person: without digits if one is, then most seen, then known, then not garbled, then first."""
    return min(spellings, key=lambda s: (any(c.isdigit() for c in s), -spellings[s], not known(s), garbled(s), list(spellings).index(s)))


def rank(read: str, name: str, spellings: Iterable[str] = ()) -> int | None:
    """How well a reading stands for a member: 0 as its name, 1 as a spelling seen before, 2 as a match; None if it doesn't."""
    f = N.fold(read)
    if not f:
        return None
    return 0 if f == N.fold(name) else 1 if f in {N.fold(s) for s in spellings} else 2 if N.matches(read, name) else None


def match_members(members: dict[str, Iterable[str]], readings: list[str], used: set[int] | None = None) -> dict[str, int]:
    """One to one: each member, in order, takes the free reading of the best rank, the first of equals."""
    used = set() if used is None else used
    out = {}
    for name, spellings in members.items():
        ranked = [(k, i) for i, s in enumerate(readings) if i not in used and (k := rank(s, name, spellings)) is not None]
        if ranked:
            out[name] = min(ranked)[1]
            used.add(out[name])
    return out


@dataclass(frozen=True)
class RosterRules:
    depart_after: int = 3
    promote_at: int = 3
    most_new: int = 12
    least_share: float = 0.40
    weak_window: int = 5
    weak_least: int = 2
    empty_most: int = 8
    empty_share: float = 0.3


def roster(rules: RosterRules = RosterRules()) -> Callable[[dict, dict], tuple[dict, list[dict]]]:
    """A step of a series' roster (row: episode, members: what was read, source).

    An episode that names far fewer than are expected, or has no source, is EMPTY_READING and changes nothing; one with less than
    a share of the active members is a FORMAT_BREAK and changes the count of breaks alone.  Otherwise active and weak members,
    then departed ones, are matched one to one; who is missing for the third time running DEPARTED, a departed one that is read
    again RETURNED to the active, a guest's third episode is PROMOTED, a weak member seen in fewer than two of the five episodes
    after the roster was locked is WEAK_DROPPED to the guests, and a burst of new names is NEW_NAMES."""

    def step(state: dict, row: dict) -> tuple[dict, list[dict]]:
        now = json.loads(json.dumps({"members": {}, "guests": {}, "version": 1, "breaks": 0, "locked": None} | state))
        e, members, guests = int(row["episode"]), now["members"], now["guests"]
        read = list(dict.fromkeys(s for s in row["members"] if s and N.fold(s)))
        told = lambda *events: (now, [{"episode": e, "event": k, "member": m, "version": now["version"]} for k, m in events])
        active = {m: s["spellings"] for m, s in members.items() if s["status"] == "ACTIVE"}
        if row.get("source") == "none" or not read or len(read) < min(rules.empty_most, math.ceil(rules.empty_share * len(active))):
            return told(("EMPTY_READING", ""))
        if not members:
            now["members"] = {s: {"status": "ACTIVE", "spellings": {s: 1}, "episodes": [e], "missing": 0} for s in read}
            now["locked"] = e
            return told()
        if active and sum(any(rank(s, m, sp) is not None for s in read) for m, sp in active.items()) < rules.least_share * len(active):
            now["breaks"] += 1
            return told(("FORMAT_BREAK", ""))
        now["breaks"] = 0
        events = [*_seen(members, read, e, used := set()), *_missing(members, e, rules), *_new(members, guests, [s for i, s in enumerate(read) if i not in used], e, rules), *_weak(members, guests, e, now["locked"], rules)]
        now["version"] += bool([k for k, _ in events if k != "NEW_NAMES"])
        return told(*events)

    return step


def _seen(members: dict, read: list[str], e: int, used: set[int]) -> Iterator[tuple[str, str]]:
    for standing in (("ACTIVE", "WEAK"), ("DEPARTED",)):
        for m, i in match_members({m: s["spellings"] for m, s in members.items() if s["status"] in standing}, read, used).items():
            s = members[m]
            s["spellings"][read[i]] = s["spellings"].get(read[i], 0) + 1
            s["episodes"], s["missing"] = sorted({*s["episodes"], e}), 0
            if s["status"] == "DEPARTED":
                s["status"] = "ACTIVE"
                yield "RETURNED", m


def _missing(members: dict, e: int, rules: RosterRules) -> Iterator[tuple[str, str]]:
    for m, s in members.items():
        if s["status"] != "DEPARTED" and e not in s["episodes"]:
            s["missing"] += 1
            if s["missing"] >= rules.depart_after:
                s["status"] = "DEPARTED"
                yield "DEPARTED", m


def _new(members: dict, guests: dict, read: list[str], e: int, rules: RosterRules) -> Iterator[tuple[str, str]]:
    fresh = 0
    for s in read:
        key = next((g for g, x in guests.items() if rank(s, g, x["spellings"]) is not None), None)
        g = guests.setdefault(s if key is None else key, {"episodes": [], "spellings": {}})
        g["episodes"], g["spellings"][s] = sorted({*g["episodes"], e}), g["spellings"].get(s, 0) + 1
        if len(g["episodes"]) < rules.promote_at:
            fresh += 1
            continue
        name = canonical(guests.pop(s if key is None else key)["spellings"])
        members[name] = {"status": "ACTIVE", "spellings": g["spellings"], "episodes": g["episodes"], "missing": 0}
        yield "PROMOTED", name
    if fresh > rules.most_new:
        yield "NEW_NAMES", str(fresh)


def _weak(members: dict, guests: dict, e: int, locked: int | None, rules: RosterRules) -> Iterator[tuple[str, str]]:
    if locked is None or e < locked + rules.weak_window:
        return
    for m in [m for m, s in members.items() if s["status"] == "WEAK"]:
        window = [x for x in members[m]["episodes"] if locked < x <= locked + rules.weak_window]
        if len(window) < rules.weak_least:
            was = guests.setdefault(m, {"episodes": [], "spellings": {}})
            gone = members.pop(m)
            was["episodes"], was["spellings"] = sorted({*was["episodes"], *window}), dict(Counter(was["spellings"]) + Counter(gone["spellings"]))
            yield "WEAK_DROPPED", m
