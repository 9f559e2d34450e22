"""Credit lines to people and roles, and the decisions on what was read.

Lines are rows (doc, pos, line).  What the line before or after means is said by windows over a document's lines; what a name means
is said by joins with the people or titles that a knowledge base knows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import name_tokens, tokens_close, tokens_match
from . import rolelexicon as L

# Words of firms, bodies, roles and labels that no person's name holds, folded.
NOT_PERSONS = (
    "film", "films", "filmi", "filmleri", "production", "productions", "prod", "pictures", "picture", "studio", "studios", "media", "entertainment",
    "company", "co", "inc", "ltd", "llc", "gmbh", "srl", "tv", "yapim", "yapimi", "yapimevi", "yapimlari", "kuvvetleri", "silahli", "ordu", "ordusu",
    "kurumu", "vakfi", "dernegi", "bakanligi", "genel", "mudurlugu", "presents", "present", "sunar", "starring", "cast", "the", "and", "ile", "feat",
    "international", "group", "team", "bros", "brothers", "sons", "enterprises", "enterprise", "corp", "corporation", "limited", "distribution",
    "releasing", "classics", "animation", "filmworks", "worldwide", "global", "networks", "network", "channel", "broadcasting", "partners",
    "associates", "foundation", "fondation", "fondazione", "stiftung", "agency", "agence", "association", "associazione", "guild", "union",
    "syndicate", "syndicat", "society", "societe", "societa", "institute", "institut", "instituto", "federation", "council", "conseil", "committee",
    "comite", "ministry", "ministere", "ministerio", "authority", "government", "gouvernement", "cinema", "cinematografica", "filmes",
    "filmproduktion", "produzione", "produktion", "telewizja", "presente", "presenta", "records", "rights", "reserved", "director", "directed",
    "producer", "produced", "executive", "associate", "yonetmen", "yapimci", "yoneten", "rejisor", "sunan", "anlatan", "music", "performed", "mixed",
    "visual", "effects", "effect", "licensing", "license", "von", "der", "die",
)
# Words of sentences, disclaimers and departments that no person's name holds, folded.
NOT_NAMES = (
    "por", "the", "del", "della", "con", "apoyo", "subvencionada", "presenta", "presents", "presente", "avec", "mit", "und", "von", "par", "fund",
    "fondo", "support", "courtesy", "arrangement", "association", "produced", "directed", "production", "produccion", "pelicula", "film", "films",
    "colaboracion", "gracias", "thanks", "tarafindan", "destek", "katki", "sunar", "ile", "tarafından", "yapim", "yapimi", "music", "starring",
    "cast", "story", "screenplay", "written", "based", "company", "pictures", "studio", "media", "entertainment", "all", "rights", "performed",
    "mixed", "visual", "effects", "effect", "licensing", "license", "records", "direktoru", "direktor", "yonetmeni", "yonetmen", "menajerlik",
    "menajer", "ajans", "ajansi", "ekibi", "amiri", "sefi", "sorumlusu", "operatoru", "koordinator", "kordinator", "muhendis", "teknisyen",
    "asistani", "yardimcisi", "supervisor", "coordinator", "manager", "designer", "casting", "editor", "mixer", "gaffer", "grip", "efekt", "asst",
)
# Particles of family names, which let a name have five or six words.
FAMILY_PARTICLES = ("de", "la", "le", "van", "von", "di", "del", "da", "dos", "el", "al", "bin", "der", "den")
# Endings of sentences rather than names, words of roles and bodies, and role words that garbled ones are compared with; all folded.
VERB_ENDS = ("digi", "dugu", "digini", "erken", "erek", "mekte", "makta", "tigi", "tugu", "mistir", "mustur")
ROLE_TOKENS = (
    "kuvvetleri", "silahli", "mustereken", "cevirdigi", "cevirme", "tarafindan", "ordu", "ordusu", "designer", "director", "producer", "editor",
    "operator", "senators", "senator", "chorus", "iorus", "makeup", "maksup", "basigner", "filmi", "filmhi", "sanak", "piimim", "somr", "arsuanl",
    "theban", "produced", "directed", "screenplay", "camera", "music", "sound", "costume", "company", "studio", "pictures", "presents", "starring",
    "performed", "mixed", "engineered", "arranged", "recorded", "mastered", "composed", "conducted", "orchestrated", "courtesy", "licensing",
    "records", "soundtrack", "services", "productions", "entertainment", "studios", "rights", "reserved", "coordinator", "security", "catering",
    "wrangler", "gaffer", "transportation", "transport", "department", "facilities", "standby", "accountant", "publicist", "casting", "wardrobe",
    "stunts", "rerecording", "supervising", "visual", "effects", "colorist", "colourist", "dubbing", "distributed", "distribution",
)
ROLE_WORDS = ("designer", "director", "producer", "editor", "operator", "cameraman", "supervisor", "assistant", "composer")


def _w(by: str, pos: str):
    return Window.partitionBy(by).orderBy(pos)


def valid_person(name: Column) -> Column:
    """At least two tokens of two letters or more, or one beside initials alone; at most four tokens, or six with a family
    particle or initials alone; no digit or sign of a list, no word that isn't a name's, nothing garbled."""
    t = T.tokens(T.ascii_fold(name))
    real = F.size(F.filter(t, lambda x: F.length(x) >= 2))
    initials = (real == 1) & (F.size(t) > 1) & ~F.exists(t, lambda x: (F.length(x) == 1) & ~x.rlike("[a-z]"))
    has = lambda words: F.arrays_overlap(t, F.array(*[F.lit(w) for w in words]))
    size = (F.size(t) <= 6) & (initials | (real >= 2)) & ((F.size(t) <= 4) | initials | has(FAMILY_PARTICLES))
    return F.coalesce(size & ~name.rlike(r"[<>|/\\@&\p{N}]") & ~has(NOT_PERSONS) & ~has(NOT_NAMES) & garbled(name).isNull(), F.lit(False))


def noise(line: Column) -> Column:
    """Too short, without a letter, or prose."""
    t = F.trim(line)
    return (F.length(t) < 2) | ~t.rlike(r"\p{L}") | ((F.size(T.words(t)) > 8) & t.rlike(r"[.!?]$"))


def garbled(name: Column) -> Column:
    """Why a name can't be one; null if it may."""
    t = T.tokens(F.regexp_replace(T.ascii_fold(name), "[^a-z]+", " "))
    verb = F.exists(t, lambda x: (F.length(x) > 5) & x.rlike("(?:" + "|".join(VERB_ENDS) + ")$"))
    role = F.arrays_overlap(t, F.array(*[F.lit(w) for w in ROLE_TOKENS]))
    # tokens whose length lets them be near one of the role words
    least, most = min(map(len, ROLE_WORDS)) - 2, max(map(len, ROLE_WORDS)) + 2
    near = F.exists(t, lambda x: (F.length(x) >= max(6, least)) & (F.length(x) <= most) & F.coalesce(*[F.when(F.levenshtein(x, F.lit(r), 2).between(1, 2), True) for r in ROLE_WORDS], F.lit(False)))
    return F.when(verb, "sentence").when(role, "role").when(near, "role word")


def without_boilerplate(lines: DataFrame, line: str) -> DataFrame:
    """Lines without those of rights, thanks, places and equipment, and without those that hold their marks."""
    return lines.where(~F.coalesce(L.boilerplate(F.col(line)), F.lit(False)))


def stop_cards(lines: DataFrame, by: str, pos: str, line: str, opening: str, closing: str, card: str) -> DataFrame:
    """Lines without those that match card, and without blocks from a line that starts with opening to one within the next four
    that holds closing; card's number is kept in ``card_no`` (the first of a document)."""
    f = T.ascii_fold(line)
    w = _w(by, pos)
    d = lines.withColumns({"_open": f.startswith(opening), "_close": f.contains(closing), "_no": F.regexp_extract(f, card, 1)})
    # a block reaches from its opening to the first closing line at most four further on
    d = d.withColumn("_to", F.when(F.col("_open"), F.coalesce(*[F.when(F.lead("_close", k).over(w), k) for k in range(1, 5)])))
    inside = F.coalesce(*[F.when(F.lag("_to", k).over(w) >= k, True) for k in range(1, 5)], F.lit(False))
    d = d.withColumn("_drop", inside | F.col("_to").isNotNull() | F.col("_close") | (F.col("_no") != ""))
    first = F.first(F.when(F.col("_no") != "", F.col("_no").cast("int")), True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return d.withColumn("card_no", first).where(~F.col("_drop")).drop("_open", "_close", "_no", "_to", "_drop")


def head_of(line: Column) -> Column:
    """The role whose head a line is or starts with; null if none, or if the line names another role."""
    n = L.normal(line)
    return F.when(~L.excluded(n), F.coalesce(*[F.when(n.rlike(f"^(?:{L._either(heads)})(?: |$)"), F.lit(role)) for role, heads in L.ROLES.items()]))


def anchored_roles(lines: DataFrame, by: str, pos: str, line: str) -> DataFrame:
    """Names by role: on the head's own line, else on the next two lines, else on the line before; by, role, rank, name."""
    return L.anchored(lines, by, pos, line)


def parsed_credits(lines: DataFrame, by: str, pos: str, line: str, caps: dict[str, int] | None = None) -> DataFrame:
    """Each valid name with the role of the last head before it, joint names cut apart, each fold once a role: by, role, rank, name."""
    w = _w(by, pos)
    d = lines.withColumn("_head", head_of(F.col(line)))
    d = d.withColumn("role", F.last("_head", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_head").isNull() & F.col("role").isNotNull() & ~L.guest_head(F.col(line)))
    d = d.select(by, pos, "role", F.posexplode(F.split(line, r"\s*(?:&|,| ve )\s*")).alias("_k", "name")).where(valid_person(F.col("name")))
    d = d.withColumn("_f", T.ascii_fold("name")).withColumn("_d", F.row_number().over(Window.partitionBy(by, "role", "_f").orderBy(pos, "_k"))).where("_d = 1")
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy(by, "role").orderBy(pos, "_k")))
    limit = F.coalesce(*[F.when(F.col("role") == r, n) for r, n in (caps or {"cast": 8, "director": 3, "producer": 3}).items()], F.lit(99))
    return d.where(F.col("rank") <= limit).select(by, "role", "rank", "name")


def guests(lines: DataFrame, by: str, pos: str, line: str) -> DataFrame:
    """Names in blocks under a head of guests, up to the next head of a role; joint names are cut apart."""
    w = _w(by, pos)
    d = lines.withColumn("_k", F.when(L.guest_head(F.col(line)), "guest").when(head_of(F.col(line)).isNotNull(), "role"))
    d = d.withColumn("_in", F.last("_k", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.where((F.col("_in") == "guest") & F.col("_k").isNull()).select(by, F.explode(F.split(F.trim(F.col(line)), r"\s*&\s*|\s+(?i:ve)\s+")).alias("name"))
    return d.where(valid_person(F.col("name"))).dropDuplicates([by, "name"])


def guarded(names: DataFrame, name: str, seen: Column, title: Column) -> DataFrame:
    """Names all of whose tokens of over two letters were seen, of four tokens at most, that aren't the title."""
    t = T.tokens(T.ascii_fold(name))
    long = F.filter(t, lambda x: F.length(x) > 2)
    ok = (F.size(long) > 0) & F.forall(long, lambda x: F.array_contains(seen, x)) & (F.size(t) <= 4) & (T.ascii_fold(name) != T.ascii_fold(title))
    return names.where(ok)


def consensus_line(names: DataFrame, lines: DataFrame, by: str, name: str, line: str) -> DataFrame:
    """The most frequent line of a document that holds all tokens of a name and one more at most; the name itself if none does."""
    t, u = T.tokens(T.ascii_fold(name)), T.tokens(T.ascii_fold(line))
    a = names.withColumns({"_t": t, "_k": F.get(t, F.lit(0))})
    b = lines.select(by, F.trim(line).alias("_l"), u.alias("_u")).withColumn("_k", F.explode(F.array_distinct("_u")))
    hit = a.join(b, [by, "_k"]).where((F.size("_t") >= 2) & F.size("_u").between(F.size("_t"), F.size("_t") + 1) & (F.size(F.array_except("_t", "_u")) == 0))
    best = hit.groupBy(by, name, "_l").count().groupBy(by, name).agg(F.min_by("_l", F.struct(-F.col("count"), F.col("_l"))).alias("_b"))
    return names.join(best, [by, name], "left").select(by, name, F.coalesce("_b", name).alias("line"))


def confirmed_cast(read: DataFrame, known: DataFrame, seen: DataFrame, by: str, most: int = 8) -> DataFrame:
    """What becomes of each read name (by, pos, name): kept as a known one's match, corrected to a near one, kept as a second reader's,
    or dropped; then known names fill up to most.  by, name, source, rank (null for dropped ones)."""
    # names are folded before they meet
    k = known.select(by, F.col("pos").alias("_kp"), F.col("name").alias("_kn"), T.ascii_fold("name").alias("_kf"), name_tokens(F.col("name")).alias("_kt"))
    asked = read.select(by, "pos", "name", name_tokens(F.col("name")).alias("_t"))
    j = asked.join(k, by, "left").withColumn("_q", F.when(tokens_match(F.col("_t"), F.col("_kt")), 0).when(tokens_close(F.col("_t"), F.col("_kt")), 1))
    best = j.groupBy(by, "pos", "name").agg(F.min_by(F.struct("_q", "_kn", "_kf"), F.struct(F.coalesce("_q", F.lit(9)), F.col("_kp"))).alias("b"))
    s = asked.join(seen.select(by, name_tokens(F.col("name")).alias("_st")), by).where(tokens_match(F.col("_t"), F.col("_st"))).select(by, "pos", F.lit(True).alias("_s")).distinct()
    r = best.join(s, [by, "pos"], "left").withColumn("source", F.when(F.col("b._q") == 0, "confirmed").when(F.col("b._q") == 1, "corrected").when(F.col("_s"), "second").otherwise("dropped"))
    r = r.select(by, "pos", F.when(F.col("source") == "corrected", F.col("b._kn")).otherwise(F.col("name")).alias("name"), "source", F.when(F.col("b._q").isNotNull(), F.col("b._kf")).alias("_key"))
    r = r.withColumn("_d", F.when(F.col("_key").isNotNull(), F.row_number().over(Window.partitionBy(by, "_key").orderBy("pos"))).otherwise(1)).where("_d = 1")
    fill = k.withColumnRenamed("_kf", "_key").join(r.where("_key is not null").select(by, "_key"), [by, "_key"], "left_anti").select(by, (F.col("_kp") + 1_000_000).alias("pos"), F.col("_kn").alias("name"), F.lit("filled").alias("source"))
    out = r.select(by, "pos", "name", "source").unionByName(fill)
    rank = F.row_number().over(Window.partitionBy(by, F.col("source") == "dropped").orderBy("pos"))
    out = out.withColumn("rank", F.when(F.col("source") != "dropped", rank))
    return out.where(F.col("rank").isNull() | (F.col("rank") <= most)).select(by, "name", "source", "rank")


def unsigned(read: DataFrame, known: DataFrame, seen: DataFrame, by: str, locked: Column) -> DataFrame:
    """Read names that neither the known nor the second reader's names match, where the identity is locked."""
    both = known.select(by, name_tokens(F.col("name")).alias("_o")).unionByName(seen.select(by, name_tokens(F.col("name")).alias("_o")))
    asked = read.select(by, "name", name_tokens(F.col("name")).alias("_t"))
    hit = asked.join(both, by).where(tokens_match(F.col("_t"), F.col("_o"))).select(by, "name").distinct().withColumn("_h", F.lit(True))
    return read.join(hit, [by, "name"], "left").withColumn("suspect", locked & F.col("_h").isNull()).drop("_h")


def director_decision(read: Column, verdict: Column, overlap: Column, known: Column, least: int = 2) -> Column:
    """struct(director, source, review)."""
    locked = (F.coalesce(overlap, F.lit(0)) >= least) & known.isNotNull()
    empty = read.isNull() | (read == "")
    pick = F.when(verdict == "CONFIRMED", read).when(empty & locked, known).when((verdict == "CONFLICT") & locked, known).otherwise("")
    source = F.when(verdict == "CONFIRMED", "read").when(empty & locked, "filled").when((verdict == "CONFLICT") & locked, "replaced").otherwise("unread")
    return F.struct(pick.alias("director"), source.alias("source"), (source == "unread").alias("review"))


def director_anchor(candidates: DataFrame, by: str, title_hit: Column, overlap: Column, year_near: Column, film: str) -> DataFrame:
    """The only candidate of a director's films with the title, or with shared cast (strong); the only one, or only one of the year (weak)."""
    c = candidates.withColumns({"_t": title_hit, "_c": overlap >= 1, "_y": year_near})
    a = c.groupBy(by).agg(*[F.count_if(x).alias(f"n{k}") for k, x in (("t", F.col("_t")), ("c", F.col("_c")), ("y", F.col("_y")))], F.count("*").alias("n"), *[F.max(F.when(x, F.col(film))).alias(f"f{k}") for k, x in (("t", F.col("_t")), ("c", F.col("_c")), ("y", F.col("_y")))], F.max(film).alias("f"))
    pick = F.when(F.col("nt") == 1, F.col("ft")).when(F.col("nc") == 1, F.col("fc")).when(F.col("n") == 1, F.col("f")).when(F.col("ny") == 1, F.col("fy"))
    tier = F.when((F.col("nt") == 1) | (F.col("nc") == 1), "strong").when((F.col("n") == 1) | (F.col("ny") == 1), "weak")
    return a.select(by, pick.alias(film), tier.alias("tier")).where("tier is not null")


def sources_agree(votes: DataFrame, by: str, source: str, value: str) -> DataFrame:
    """The value that most independent sources give: CONFIRMED by two of them, SINGLE by one, CONFLICT where values of as many sources differ."""
    v = votes.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count_distinct(source).alias("n"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), value)
    r = v.withColumns({"_r": F.row_number().over(w), "_next": F.coalesce(F.lead("n").over(w), F.lit(0))}).where("_r = 1")
    return r.select(by, value, "n", F.when(F.col("n") == F.col("_next"), "CONFLICT").when(F.col("n") >= 2, "CONFIRMED").otherwise("SINGLE").alias("verdict"))


def fallback_need(status: Column, scroll_lines: Column, cards: Column) -> Column:
    """Why another engine must read again; null if it needn't."""
    none = F.coalesce(scroll_lines, F.lit(0)) == 0
    n = F.coalesce(cards, F.lit(0))
    return F.when(status.startswith("BROKEN"), F.concat(F.lit("broken:"), status)).when(none & (n == 0), "nothing_read").when(none & (n <= 3), "few_cards")


def unwitnessed(names: DataFrame, witnesses: DataFrame, by: str) -> DataFrame:
    """Names that no witness of their document matches; none where a document has no witness at all."""
    w = witnesses.where("name != ''").select(by, name_tokens(F.col("name")).alias("_w"))
    has = w.select(by).distinct()
    asked = names.select(by, "name", name_tokens(F.col("name")).alias("_t"))
    hit = asked.join(w, by).where(tokens_match(F.col("_t"), F.col("_w")) | tokens_close(F.col("_t"), F.col("_w"))).select(by, "name").distinct()
    return names.join(has, by, "left_semi").join(hit, [by, "name"], "left_anti")


def genre_class(*values: Column) -> Column:
    """The first special genre that a value names; OTHER if none."""
    special = lambda v: F.when(v.rlike("(?i)belgesel|documentary"), "DOCUMENTARY").when(v.rlike("(?i)animasyon|animation|çizgi"), "ANIMATION").when(v.rlike("(?i)konser|concert|müzik|music"), "MUSIC")
    return F.coalesce(*[special(v) for v in values], F.lit("OTHER"))


def lexicon_replace(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Whole words replaced by their canonical form, in the order of the rules; letters of any script belong to a word."""
    for word, canonical in rules:
        text = F.regexp_replace(text, rf"(?<![\p{{L}}\p{{N}}_])(?i:{word})(?![\p{{L}}\p{{N}}_])", canonical)
    return text


# Words of Arabic dialects and their standard forms, in the order they are replaced.
DIALECTS = {
    "levantine": (
        ("هلأ", "الآن"), ("هلاء", "الآن"), ("هلق", "الآن"), ("هلا", "الآن"), ("ليش", "لماذا"), ("شو", "ماذا"), ("بدنا", "نريد أن"), ("بدي", "أريد أن"), ("بدك", "تريد أن"),
        ("بدو", "يريد أن"), ("بدها", "تريد أن"), ("بدهم", "يريدون أن"), ("بد", "يجب أن"), ("نروح", "نذهب"), ("تروح", "تذهب"), ("يروح", "يذهب"), ("روح", "اذهب"), ("كتير", "كثيرا"), ("مو", "ليس"), ("هون", "هنا"), ("هونيك", "هناك"),
    ),
    "egyptian": (("دلوقتي", "الآن"), ("ايه", "ماذا"), ("إيه", "ماذا"), ("ليه", "لماذا"), ("عايز", "أريد أن"), ("عاوز", "أريد أن"), ("مش", "ليس"), ("أوي", "كثيرا")),
    "gulf": (("الحين", "الآن"), ("وش", "ماذا"), ("شلون", "كيف"), ("أبي", "أريد أن"), ("ابغى", "أريد أن"), ("أبغى", "أريد أن"), ("وايد", "كثيرا"), ("واجد", "كثيرا"), ("وين", "أين")),
    "maghrebi": (("دابا", "الآن"), ("شنو", "ماذا"), ("واش", "هل"), ("علاش", "لماذا"), ("بزاف", "كثيرا"), ("بغيت", "أريد أن"), ("برشا", "كثيرا")),
}
# Phrases of one dialect that are replaced before its words, and what stands before a verb's first letter.
LEVANTINE_PHRASES = (("لعندي على البيت", "إلى بيتي"), ("لعندي عالبيت", "إلى بيتي"), ("عندي على البيت", "إلى بيتي"), ("عندي عالبيت", "إلى بيتي"), ("على البيت", "إلى البيت"), ("عالبيت", "إلى البيت"))
LEVANTINE_MUST, MUST, LEVANTINE_LAST = ("بد", "ن"), "يجب أن ", ("أنا لماذا يجب أن ن", "لماذا يجب أن ن")
# Words of the dialects and their weights; the first dialect wins a tie.
DIALECT_MARKERS = {
    "levantine": [("هلأ", 3), ("هلق", 3), ("هلاء", 3), ("ليش", 2), ("شو", 2), ("بدي", 2), ("بدنا", 2), ("بدك", 2), ("بد", 2), ("كتير", 1), ("مو", 1), ("هون", 1), ("هونيك", 1), ("عالبيت", 2)],
    "egyptian": [("دلوقتي", 3), ("عايز", 3), ("عاوز", 3), ("ايه", 2), ("إيه", 2), ("ليه", 1), ("أوي", 1), ("مش", 1)],
    "gulf": [("الحين", 3), ("وش", 2), ("شلون", 2), ("أبي", 2), ("ابغى", 2), ("أبغى", 2), ("وايد", 1), ("واجد", 1), ("وين", 1)],
    "maghrebi": [("دابا", 3), ("شنو", 2), ("واش", 2), ("علاش", 2), ("بزاف", 2), ("بغيت", 2), ("برشا", 1)],
}
_ARABIC = r"\x{0600}-\x{06ff}\x{0750}-\x{077f}\x{08a0}-\x{08ff}\x{fb50}-\x{fdff}\x{fe70}-\x{feff}"


def _arabic_word(word: str) -> str:
    return rf"(?<![{_ARABIC}]){word}(?![{_ARABIC}])"


def dialect(text: Column) -> Column:
    """The Arabic dialect whose markers weigh most, without vowel signs; standard where none is found."""
    plain = F.regexp_replace(text, r"[\x{064b}-\x{065f}\x{0670}]", "")
    score = lambda markers: sum((F.when(plain.rlike(_arabic_word(w)), n).otherwise(0) for w, n in markers), F.lit(0))
    top = F.array_max(F.array(*[F.struct(score(m).alias("s"), F.lit(-k).alias("k"), F.lit(v).alias("v")) for k, (v, m) in enumerate(DIALECT_MARKERS.items())]))
    return F.when(top["s"] > 0, top["v"]).otherwise("standard")


def standard_arabic(text: Column, variant: Column) -> Column:
    """A text of a dialect with its words in standard form; of any other variant as it is."""
    out = text
    for name, words in DIALECTS.items():
        t = text
        if name == "levantine":
            for phrase, form in LEVANTINE_PHRASES:
                t = F.replace(t, F.lit(phrase), F.lit(form))
            t = F.regexp_replace(t, rf"{_arabic_word(LEVANTINE_MUST[0])}\s+(?={LEVANTINE_MUST[1]})", MUST)
        for word, form in words:
            t = F.regexp_replace(t, _arabic_word(word), form)
        if name == "levantine":
            t = F.replace(t, *map(F.lit, LEVANTINE_LAST))
        out = F.when(variant == name, t).otherwise(out)
    return out


def variant_scores(text: Column, markers: dict[str, list[tuple[str, int]]], default: str) -> Column:
    """The variant whose markers weigh most in a text, the first of equals; default where none is found."""
    score = lambda m: sum((F.when(text.rlike(rf"(?<!\p{{L}}){w}(?!\p{{L}})"), n).otherwise(0) for w, n in m), F.lit(0))
    top = F.array_max(F.array(*[F.struct(score(m).alias("s"), F.lit(-k).alias("k"), F.lit(v).alias("v")) for k, (v, m) in enumerate(markers.items())]))
    return F.when(top["s"] > 0, top["v"]).otherwise(default)
