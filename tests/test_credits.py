"""Roles read off credit lines, against loops over a document's lines."""

import re
import unicodedata

from cairnflow import catalogue, plans  # noqa: F401
from cairnflow.functions import names as N
from cairnflow.operators import credits
from cairnflow.operators import rolelexicon as L
from cairnflow.plans import credits as P
from cairnflow.plans.credits import credit_lines


def norm(s):
    s = unicodedata.normalize("NFKD", s.replace("ı", "i").replace("İ", "i"))
    return " ".join(re.sub("[^A-Z]", " ", "".join(c for c in s if not unicodedata.combining(c)).upper()).split())


def head_of(n, heads):
    fits = [h for h in heads if n == h or n.startswith(h + " ") or n.endswith(" " + h)]
    return max(fits, key=len) if fits else ""


def other(n):
    return any(x in n for x in L.EXCLUDE)


def name(n):
    t = n.split()
    if not 1 <= len(t) <= 5 or t[0] in L.ROLE_LEADERS or set(t) & set(L.FIRMS):
        return False
    if any((n + " ").startswith(h + " ") for heads in L.ROLES.values() for h in heads):
        return False
    return len(t) < 3 or sum(w in L.SENTENCE_WORDS for w in t) < 2


CARD = re.compile("(?:A|AN|BIR) ([A-Z]+(?: [A-Z]+){0,2}) (?:FILM|FILMI|FILMS)")


def director(line):
    n = norm(line)
    t = n.split()
    if not n or other(n) or t[0] == "DIRECTOR" and any(w.startswith("PH") for w in t[1:]) or t[-1] in ("DIRECTOR", "DIRECTORS") and set(t) & set(L.TECHNICAL):
        return ""
    if m := CARD.fullmatch(n):
        return m[1] if name(m[1]) and not set(m[1].split()) & set(L.STUDIOS) else ""
    h = head_of(n, L.DIRECTOR)
    rest = n[len(h) :].strip() if n.startswith(h + " ") else n[: -len(h)].strip() if h and n.endswith(" " + h) else ""
    return rest if h and rest and name(rest) and not other(rest) and not set(rest.split()) & set(L.STUDIOS) else ""


def anchored(lines):
    raw = [x.strip() for x in lines if x and x.strip()]
    ns = [norm(x) for x in raw]
    ok = [name(n) and not other(n) for n in ns]
    out = {r: [] for r in L.ROLES}
    for i, n in enumerate(ns):
        if other(n):
            continue
        m = CARD.fullmatch(n)
        if m and name(m[1]) and not set(m[1].split()) & set(L.STUDIOS):
            got, role = [" ".join(raw[i].split()[1:-1])], "director"
        else:
            role, h = next(((r, h) for r, heads in L.ROLES.items() if (h := head_of(n, heads))), (None, ""))
            if role is None:
                continue
            k, words = len(h.split()), raw[i].split()
            own = (" ".join(words[k:]) if n.startswith(h + " ") else " ".join(words[:-k]) if n.endswith(" " + h) else "").strip(" :,-–—\t")
            if own and name(norm(own)) and not other(norm(own)):
                got = [own]
            else:
                got = [raw[i + 1]] if i + 1 < len(raw) and ok[i + 1] else []
                got += [raw[i + 2]] if got and i + 2 < len(raw) and ok[i + 2] else []
                got = got or ([raw[i - 1]] if i and ok[i - 1] else [])
        out[role] += [g for g in dict.fromkeys(got) if g not in out[role]]
    return {(r, k + 1, x) for r, names in out.items() for k, x in enumerate(names[: 8 if r == "cast" else None])}


TEXTS = {
    "tr": "OYUNCULAR\nKEMAL SUNAL\nŞENER ŞEN\nYÖNETMEN\nERTEM EĞİLMEZ\nYÖNETMEN YARDIMCISI\nALİ VELİ",
    "en": "Directed by John Ford\nProduced by Merian C. Cooper\nDirector of Photography Gregg Toland\nStarring\nJohn Wayne\nMaureen O'Hara",
    "fr": "Un film de Jean Renoir\nAvec\nJean Gabin\nMichel Simon\nAssistant réalisateur Jacques Becker",
    "de": "Regie\nFritz Lang\nKamera Karl Freund\nMit\nPeter Lorre",
    "it": "Regia\nFederico Fellini\nProdotto da Dino De Laurentiis\nDirettore della fotografia Otello Martelli",
    "card": "A NIKI CARO FILM\nA WALT DISNEY FILM\n\nJane Doe\nRegista",
    "many": "Cast\n" + "\n".join(f"Starring {a}nna {b}eck" for a in "ABC" for b in "XYZ"),
    "joint": "PRODUIT ET DIRIGE PAR\nH.G. CLOUZOT\nDIRECTED BY\nEXPLODED THROUGHOUT AN UNSUSPECTING AND\nDirected by Acme Pictures",
}


def test_roles_of_many_languages(spark):
    rows = [(k, i, x) for k, t in TEXTS.items() for i, x in enumerate(t.split("\n"))] + [("null", 0, None), ("null", 1, "Regie"), ("null", 2, None), ("null", 3, "Anna Beck")]
    got = {}
    for r in credits.anchored_roles(spark.createDataFrame(rows, "d string, p int, l string"), "d", "p", "l").collect():
        got.setdefault(r.d, set()).add((r.role, r["rank"], r.name))
    by = lambda k, role: [n for r, _, n in sorted(got[k]) if r == role]
    assert by("tr", "director") == ["ERTEM EĞİLMEZ"] and by("tr", "cast") == ["KEMAL SUNAL", "ŞENER ŞEN"]
    assert by("en", "director") == ["John Ford"] and by("en", "producer") == ["Merian C. Cooper"] and by("en", "cast") == ["John Wayne", "Maureen O'Hara"]
    assert by("fr", "director") == ["Jean Renoir"] and by("fr", "cast") == ["Jean Gabin", "Michel Simon"]
    assert by("de", "director") == ["Fritz Lang"] and by("de", "cast") == ["Peter Lorre"]
    assert by("it", "director") == ["Federico Fellini"] and by("it", "producer") == ["Dino De Laurentiis"]
    assert by("card", "director") == ["NIKI CARO", "Jane Doe"] and len(by("many", "cast")) == 8
    for k, t in TEXTS.items():
        assert got[k] == anchored(t.split("\n")), k


def test_directors_that_lines_name(spark):
    said = ["A NIKI CARO FILM", "DIRECTED BY JOHN FORD", "Director", "DIRECTOR OF PHON", "Lead Environmental Technical Director", "A Warner Bros Film", "Assistant Director X Y", "Bir Ertem Eğilmez Filmi", "John Ford Regie", "Directed by Fox Films", "", None, "Second Unit Director A B"]
    got = [r.x for r in spark.createDataFrame([(k, s) for k, s in enumerate(said)], "k int, l string").orderBy("k").select(L.director_name(credits.F.col("l")).alias("x")).collect()]
    assert got == [director(s) if s else "" for s in said]
    assert got[0] == "NIKI CARO" and got[1] == "JOHN FORD" and got[7] == "ERTEM EGILMEZ" and got[2:7] == [""] * 5


def test_guest_blocks_and_boilerplate(spark):
    lines = ["Konuk Oyuncular:", "Ali Kaya & Veli Demir", "Ayse Kaya ve Bo Lund", "konuk oyuncularin secimi", "Yönetmen", "Mert Oz", "SPECIAL GUESTS", "Ada Lovelace"]
    d = spark.createDataFrame([("d", k, s) for k, s in enumerate(lines)], "d string, p int, l string")
    assert {r.name for r in credits.guests(d, "d", "p", "l").collect()} >= {"Ali Kaya", "Veli Demir", "Ayse Kaya", "Bo Lund", "Ada Lovelace"}
    assert "Mert Oz" not in {r.name for r in credits.guests(d, "d", "p", "l").collect()}
    text = ["Based on a novel", "Dolby  Digital", "© 2001", "In memory of X", "Anna Beck", None]
    left = credits.without_boilerplate(spark.createDataFrame([(s,) for s in text], "l string"), "l").collect()
    assert [r.l for r in left] == ["Anna Beck", None]


def test_anchored_roles_of_the_whole_table(spark, sf_dir):
    docs = {}
    for r in credit_lines(spark, sf_dir).orderBy("doc", "pos").collect():
        docs.setdefault(r.doc, []).append(r.line)
    want = {(d, *x) for d, lines in docs.items() for x in anchored(lines)}
    assert {tuple(r) for r in catalogue.queries()["anchored_roles"](spark, sf_dir).collect()} == want
    named = {}
    for d, lines in docs.items():
        for x in filter(None, map(director, lines)):
            named[d, x] = named.get((d, x), 0) + 1
    assert {(r.doc, r.director): r.n for r in catalogue.queries()["line_directors"](spark, sf_dir).collect()} == named
    assert {r for _, r, *_ in want} == {"director", "producer", "cast"} and named


# -- what readers and sources say ----------------------------------------------------


def jw(a, b):
    from cairnflow.functions.similarity import _jaro_winkler

    return _jaro_winkler(a, b)


def misread(n):
    from cairnflow.operators.credits import ROLE_TOKENS

    assert not set(N.fold(n).split()) & set(ROLE_TOKENS)
    return any(len(w) >= 3 and any(c.isupper() for c in w[1:]) and any(c.islower() for c in w) for w in n.split())


def fused(votes, known):
    """By walking one work's votes (model, pos, name) in order."""
    first = {}
    for m, p, n in sorted(votes, key=lambda v: v[:2]):
        if N.fold(n):
            first.setdefault(N.fold(n), n.strip())
    models = {f: len({m for m, _, n in votes if N.fold(n) == f}) for f in first}
    ok = {f: any(o for n, o in known if N.fold(n) == f) for f in {N.fold(n) for n, _ in known}}
    agreed = [f for f in first if models[f] >= 2]
    if agreed:
        kept = [f for f in agreed if ok.get(f, True)] or agreed
        return [first[f] for f in kept], "agreed"
    if right := [f for f in first if ok.get(f)]:
        return [first[f] for f in right], "known"
    canon = set()
    for f, n in first.items():
        near = sorted(((jw(f, N.fold(k)), k) for k, o in known if o and N.edits(f, N.fold(k), 2) <= 2 and jw(f, N.fold(k)) >= 0.9), reverse=True) if misread(n) else []
        if near and (len(near) == 1 or near[0][0] - near[1][0] >= 0.03):
            canon.add(near[0][1])
    if len(canon) == 1:
        return list(canon), "canonical"
    return (list(first.values()), "single") if len(first) == 1 else ([], "unread")


def validated(read, sources):
    """read: names in order; sources: (source, names, independent)."""
    sure, canon, conflicts = {d: set() for d in read}, {}, []
    for source, pool, independent in sorted(sources):
        hit = False
        for d in read:
            m = next((k for k in pool if N.matches(d, k)), None)
            if m:
                hit = True
                canon.setdefault(d, m)
                if independent:
                    sure[d].add(source)
        if not hit and not any(N.close(d, k) for d in read for k in pool):
            conflicts.append((source, pool))
    by = sorted(set().union(*sure.values()))
    cands = sorted({k for _, pool in conflicts for k in pool})
    if len(conflicts) > bool(by):
        return read, "CONFLICT", "FLAG", by, cands
    if by:
        return [canon.get(d, d) for d in read], "CONFIRMED", "HIGH" if len(by) >= 2 and all(sure.values()) else "MEDIUM", by, cands
    return read, "UNCONFIRMED", "LOW", by, cands


def grouped(rows, key="doc"):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


def test_fused_directors_of_the_whole_table(spark, sf_dir):
    known = [(r.name, r.ok) for r in P.known_people(spark, sf_dir).collect()]
    votes = grouped(P.readings(spark, sf_dir).collect())
    got = {r.doc: (r.names, r.how) for r in catalogue.queries()["fused_directors"](spark, sf_dir).collect()}
    want = {d: fused([(r.model, r.pos, r.name) for r in rows], known) for d, rows in votes.items()}
    assert got == {d: ("; ".join(n), how) for d, (n, how) in want.items()}
    assert {how for _, how in got.values()} == {"agreed", "known", "canonical", "single", "unread"}


def test_validated_directors_of_the_whole_table(spark, sf_dir):
    read = grouped(P.readings(spark, sf_dir).where("model = 0").orderBy("pos").collect())
    sources = grouped(P.director_sources(spark, sf_dir).collect())
    got = {r.doc: (r.names, r.status, r.confidence, r.confirmed_by, r.candidates) for r in catalogue.queries()["validated_directors"](spark, sf_dir).collect()}
    want = {d: validated([r.name for r in rows], [(s.source, [s.name], s.independent) for s in sources.get(d, [])]) for d, rows in read.items()}
    assert got == {d: ("; ".join(n), s, c, "; ".join(b), "; ".join(k)) for d, (n, s, c, b, k) in want.items()}
    assert {(s, c) for _, s, c, _, _ in got.values()} == {("CONFLICT", "FLAG"), ("CONFIRMED", "HIGH"), ("CONFIRMED", "MEDIUM"), ("UNCONFIRMED", "LOW")}


def test_quality_blocks_of_the_whole_table(spark, sf_dir):
    f = {r.doc: r for r in catalogue.queries()["fused_directors"](spark, sf_dir).collect()}
    got = {r.doc: r for r in catalogue.queries()["quality_blocks"](spark, sf_dir).collect()}
    sources = grouped(P.director_sources(spark, sf_dir).collect())
    assert set(got) == set(f)
    for d, r in got.items():
        names = f[d].names.split("; ") if f[d].names else []
        n, status, confidence, _, _ = validated(names, [(s.source, [s.name], s.independent) for s in sources.get(d, [])]) if names else ([], "UNREAD", None, [], [])
        verdict = "BLOCK" if status in ("UNREAD", "CONFLICT") else "REVIEW" if status == "UNCONFIRMED" or r.kept < 2 or r.dropped > r.kept else "OK"
        assert (r.directors, r.how, r.status, r.confidence, r.verdict) == ("; ".join(n), f[d].how, status, confidence, verdict)
    assert {r.verdict for r in got.values()} == {"OK", "REVIEW", "BLOCK"}


# -- entities ---------------------------------------------------------------------------


def plain_entities(text, rules):
    out = []
    for r in rules:
        for v in r.variants:
            whole, i, done = re.compile(rf"(?<!\w){re.escape(v)}(?!\w)", re.IGNORECASE), 0, ""
            while m := whole.search(text, i):
                done += text[i : m.start()] + r.canonical
                out += [(r.canonical, m[0], m.start(), m.end())] if m[0] != r.canonical else []
                i = m.end()
            text = done + text[i:]
    return text, out


def test_entities_with_their_places(spark):
    from cairnflow.operators import entities

    said = ["baris manco, Barış Manço ve BARIS MANGO'nun", "Neretfada değil Neretfa", "trt haber TRT Haber", "nothing", "", None]
    got = entities.normalised(spark.createDataFrame([(k, s, 7) for k, s in enumerate(said)], "k int, t string, entity int"), "t").orderBy("k").collect()
    for r, s in zip(got, said):
        text, found = plain_entities(s or "", entities.RULES)
        assert r.normalized_text == (text if s is not None and text != s else None)
        assert [(e.canonical, e.matched, e.start, e.end) for e in r.entities] == (found if r.normalized_text else [])
    assert got[0].normalized_text == "Barış Manço, Barış Manço ve Barış Manço'nun" and got[0].entities[0].kind == "person"
    assert got[1].normalized_text == "Neretfada değil Neretva"
    assert entities.normalised(spark.createDataFrame([("Neretfa",)], "t string"), "t", ()).first().normalized_text is None


def test_entity_spans_of_the_whole_table(spark, sf_dir):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        text, found = plain_entities(r.text or "", P.entity_rules())
        found = found if text != r.text else []
        want.add((r.conv_id, r.turn, sha(text), len(found), sha(",".join(":".join(map(str, f)) for f in found))))
    got = {tuple(r) for r in catalogue.queries()["entity_spans"](spark, sf_dir).collect()}
    assert got == want and sum(n for *_, n, _ in got) > 50
