"""Heads of roles in credits, in some fifteen languages, and the names that stand with them.

Lines are normalised: letters of A to Z in capitals, all else one space.  A head opens or closes a line, the longest one counts; a line with an
excluded head has none.  The name stands on the head's own line, else on the next two, else on the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Heads of directors, producers and casts; those with a mark in them are met in lines that keep theirs alone.
DIRECTOR = (
    "YONETMEN", "YONETEN", "REJISOR", "YONETMENI", "DIRECTED BY", "A FILM BY", "FILM BY", "DIRECTOR", "DIRECTION",
    "WRITTEN AND DIRECTED", "DIRECTED AND EDITED", "PRODUCED AND DIRECTED", "WRITTEN, DIRECTED",
    "REALISE PAR", "REALISATION", "REALISATEUR", "UN FILM DE", "MISE EN SCENE", "DIRIGE PAR",
    "EIN FILM VON", "REGIE", "INSZENIERUNG", "REGISSOR", "INSTRUKTOR", "DIRETTO DA", "UN FILM DI", "REGIA", "REGISTA",
    "DIRIGIDA POR", "DIRIGIDO POR", "DIRECCION", "UNA PELICULA DE", "REALIZADO POR", "REALIZACAO", "DIRECAO",
    "DIRECTED & PHOTOGRAPHED", "PRODUCED, WRITTEN & DIRECTED", "STORY AND DIRECTION", "SCREENPLAY AND DIRECTION", "STORY, SCREENPLAY AND DIRECTION", "FILM DIRECTED BY",
    "GEREGISSEERD DOOR", "REZYSERIA", "REZIE", "RENDEZTE", "RENDEZO", "SKINOTHESIA",
    "REZHISSER", "REZHISSYOR", "REJISSER", "POSTANOVKA", "REZHYSER", "REZHISOR", "REZIJA", "REDATELJ",
    "NIRDESHAK", "NIRDESHAN", "KARGARDAN", "IKHRAJ", "MUKHRIJ", "KANTOKU", "DAOYAN",
    "PRODUIT ET DIRIGE PAR", "PRODUIT ET REALISE PAR", "ECRIT ET REALISE PAR", "ECRIT ET DIRIGE PAR", "PRODUCED AND DIRECTED BY",
    "WRITTEN AND DIRECTED BY", "DIRECTED AND PRODUCED BY", "PRODUCED WRITTEN AND DIRECTED BY",
)
PRODUCER = (
    "YURUTUCU YAPIMCI", "YAPIMCI", "YAPIM", "EXECUTIVE PRODUCER", "PRODUCED BY", "PRODUCER", "PRODUCTION", "PRODUIT PAR", "PRODUCTEUR", "PRODUCTRICE",
    "HERGESTELLT VON", "PRODUZENT", "PRODUKTION", "PRODOTTO DA", "PRODUTTORE", "PRODUZIONE", "PRODUCIDA POR", "PRODUCIDO POR", "PRODUCTOR", "PRODUCCION",
    "PRODUZIDO POR", "PRODUTOR", "PRODUCAO", "PRODUCENT", "PRODUCENTER", "EXEKUTIV PRODUCENT", "EXEKUTIVA PRODUCENTER",
    "PRODUCTIE", "PRODUKCJA", "PRODUKCE", "GYARTO", "PRODUCATOR", "PRODYUSER", "PRODJUSER", "NIRMATA", "MUNTIJ", "SEISAKU", "ZHIPIAN",
)
CAST = (
    "ROL DAGILIMI", "OYNAYANLAR", "OYUNCULAR", "OYUNCU", "STARRING", "FEATURING", "CAST", "WITH", "INTERPRETES", "DISTRIBUTION", "AVEC",
    "DARSTELLER", "BESETZUNG", "MIT", "INTERPRETI", "CON", "REPARTO", "ELENCO", "COM",
)
# What a line holds that names another role than those.
EXCLUDE = (
    "YARDIMCI", "SESLENDIRME", "MUZIK", "GORUNTU", "SANAT", "DUBLAJ", "CASTING", "ASSISTANT", "ASSOCIATE", "SECOND UNIT", "ART DIRECTOR", "CASTING DIRECTOR",
    "MUSIC DIRECTOR", "DIRECTOR OF PHOTOGRAPHY", "TECHNICAL DIRECTOR", "CO DIRECTOR", "PHOTOGRAPHY", "PRODUCTION ASSISTANT", "PRODUCTION MANAGER",
    "PRODUCTION COORDINATOR", "LINE PRODUCER", "ASSISTANT REALISATEUR", "DIRECTEUR DE LA PHOTOGRAPHIE", "DIRECTEUR ARTISTIQUE",
    "REGIEASSISTENZ", "AIUTO REGISTA", "DIRETTORE DELLA FOTOGRAFIA", "AYUDANTE DE DIRECCION", "DIRECTOR DE FOTOGRAFIA", "DIRECTOR ARTISTICO",
    "ARTISTIQUE", "ARTISTICA", "ARTISTICO", "ARTISTICH", "DIRECTION ARTISTIQUE", "DIRECAO DE ARTE", "DIREZIONE ARTISTICA", "KUNSTLERISCHE LEITUNG",
    "SANAT YONETMENI", "CO PRODUCER", "COPRODUCER", "CO-PRODUCER", "ASSOCIATE PRODUCER", "SUPERVISING PRODUCER", "CONSULTING PRODUCER", "PRODUCTION SUPERVISOR",
    "UYGULAYICI YAPIMCI", "ORTAK YAPIMCI", "YARDIMCI YAPIMCI", "DIRECTEUR DE PRODUCTION", "PRODUCTEUR ASSOCIE", "PRODUCTEUR EXECUTIF DELEGUE",
    "COPRODUZIONE", "PRODUTTORE ASSOCIATO", "PRODUCTOR ASOCIADO", "PRODUCTOR EJECUTIVO ASOCIADO", "PRODUKTIONSLEITUNG", "AUFNAHMELEITUNG",
    "SESLENDIRME YONETMENI", "DUBLAJ YONETMENI", "COLLABORATEURS", "TRUCCATORE", "FIREARMS", "ISPOLNITELI", "STUNT COORDINATOR", "STUNT",
)
# Words of firms; first words of lines that name a role; words that sentences have and names haven't; brands of studios.
FIRMS = (
    "FILM", "FILMS", "PRODUCTION", "PRODUCTIONS", "PICTURES", "STUDIO", "STUDIOS", "ENTERTAINMENT", "MEDIA", "INC", "LLC", "LTD", "COMPANY", "TV",
    "INTERNATIONAL", "GROUP", "CORP", "CORPORATION", "ASSOCIATES", "PRESENTS", "PRESENTE",
)
ROLE_LEADERS = (
    "KAMERA", "CAMERA", "GORUNTU", "PHOTOGRAPHY", "IMAGE", "FOTOGRAFIA", "MUZIK", "MUSIC", "MUSIQUE", "MUSICA", "MUSIK",
    "KURGU", "MONTAJ", "EDITOR", "EDITING", "MONTAGE", "MONTAGGIO", "SES", "SOUND", "SON", "TON", "SUONO", "SONIDO",
    "SENARYO", "SCREENPLAY", "WRITER", "WRITTEN", "SCENARIO", "DREHBUCH", "SCENEGGIATURA", "GUION",
    "SANAT", "ART", "DEKOR", "DESIGN", "DESIGNER", "DECORS", "AUSSTATTUNG", "KOSTUM", "COSTUME", "COSTUMES", "KOSTUME", "MAKYAJ", "MAKEUP", "MAKE",
    "YAPIM", "YAPIMCI", "PRODUCER", "PRODUCED", "PRODUCTION", "PRODUKTION", "PRODUZIONE", "PRODUCTEUR", "PRODUTTORE", "PRODUCTOR", "PRODUTOR", "EXECUTIVE",
    "YONETMEN", "YONETEN", "REJISOR", "DIRECTOR", "DIRECTED", "REGIE", "REGIA", "REGISTA", "REALISATION", "REALISATEUR", "REALISE", "DIRECTION", "DIRECCION",
    "OYUNCULAR", "OYUNCU", "CAST", "STARRING", "AVEC", "MIT", "CON", "REPARTO", "ELENCO",
    "SESLENDIRME", "DUBLAJ", "YARDIMCI", "ASSISTANT", "ASSOCIATE", "CASTING", "SUPERVISOR",
)
SENTENCE_WORDS = (
    "THE", "AN", "AND", "OR", "BUT", "NOR", "BY", "WITH", "WITHOUT", "FROM", "INTO", "ONTO", "THROUGH", "THROUGHOUT", "DURING", "WHILE", "WHEN", "WHERE",
    "WHICH", "WHOSE", "THAT", "THIS", "THESE", "THOSE", "ARE", "WAS", "WERE", "BEEN", "BEING", "HAVE", "HAS", "HAD", "WILL", "WOULD", "SHALL", "SHOULD",
    "COULD", "THAN", "THEN", "OU", "MAIS", "DANS", "POUR", "AVEC", "SANS", "QUE", "QUI", "UNE",
)
STUDIOS = (
    "DISNEY", "PIXAR", "MARVEL", "WARNER", "BROS", "UNIVERSAL", "PARAMOUNT", "COLUMBIA", "DREAMWORKS", "LIONSGATE", "MGM", "MIRAMAX", "NETFLIX", "AMAZON",
    "APPLE", "HBO", "SONY", "FOX", "TRISTAR", "ORION", "RKO", "BLUMHOUSE", "LUCASFILM", "STUDIOCANAL", "GAUMONT", "PATHE",
)
# Heads of guests, folded, which may carry an ending of up to four letters; words that make a director a technical one.
GUEST_HEADS = ("konuk oyuncular", "konuk oyuncu", "konuk sanatci", "konuklar", "bolum oyunculari", "bolum konuklari", "bu bolumun konuklari", "guest starring", "guest stars", "special guest")
TECHNICAL = ("TECHNICAL", "ENVIRONMENTAL")
# Boilerplate that no person's line holds, and its marks.
BOILERPLATE = (
    "COURTESY OF", "IN ASSOCIATION WITH", "EN ASSOCIATION", "AVEC LA PARTICIPATION", "WITH THE PARTICIPATION", "IN COLLABORATION WITH", "PROVIDED BY",
    "STOCK FOOTAGE", "ALL RIGHTS RESERVED", "TOUS DROITS", "COPYRIGHT", "SPECIAL THANKS", "THANKS TO", "DEDICATED TO", "IN MEMORY OF",
    "IN LOVING MEMORY", "NO ANIMALS WERE", "FILMED ON LOCATION", "SHOT ON LOCATION", "FILMED IN", "RECORDED AT", "DOLBY DIGITAL", "DOLBY STEREO",
    "DTS DIGITAL", "ULTRA STEREO", "BASED ON ", "BASED UPON", "MOTION PICTURE ASSOCIATION",
)
BOILERPLATE_MARKS = "©®™"

ROLES = {"director": DIRECTOR, "producer": PRODUCER, "cast": CAST}
_CARD = r"^(?:A|AN|BIR) ([A-Z]+(?: [A-Z]+){0,2}) (?:FILM|FILMI|FILMS)$"


def normal(line: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(T.ascii_fold(line), "[^a-z]+", " ")))


def _either(words: tuple[str, ...]) -> str:
    """The words as alternatives, the longest first."""
    return "|".join(sorted(dict.fromkeys(words), key=lambda w: (-len(w), w)))


def _any_of(tokens: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, words)))


def excluded(n: Column) -> Column:
    return n.rlike(_either(EXCLUDE))


def is_name(n: Column) -> Column:
    """Whether a normalised line may be a name: one to five words, no role's first, no head, no firm, no part of a sentence."""
    t = F.split(n, " ")
    sentence = F.size(F.filter(t, lambda w: w.isin(*SENTENCE_WORDS))) >= 2
    return (n != "") & (F.size(t) <= 5) & ~t[0].isin(*ROLE_LEADERS) & ~n.rlike(f"^(?:{_either(DIRECTOR + PRODUCER + CAST)})(?: |$)") & ~_any_of(t, FIRMS) & ~((F.size(t) >= 3) & sentence)


def head_in(n: Column, role: str) -> Column:
    """The longest head of a role that a normalised line is, begins or ends with; empty if none."""
    first, last = F.regexp_extract(n, f"^({_either(ROLES[role])})(?= |$)", 1), F.regexp_extract(n, f"(?:^| )({_either(ROLES[role])})$", 1)
    return F.when(F.length(first) >= F.length(last), first).otherwise(last)


def _clean(name: Column) -> Column:
    return F.regexp_replace(name, r"^[\s:,–—-]+|[\s:,–—-]+$", "")


def beside(line: Column, n: Column, head: Column) -> Column:
    """What a line holds besides its head, as it was written."""
    words, k = F.split(F.trim(line), r"\s+"), F.size(F.split(head, " "))
    left = F.greatest(F.lit(0), F.size(words) - k)
    return _clean(F.array_join(F.when(n.startswith(F.concat(head, F.lit(" "))), F.slice(words, k + 1, F.greatest(left, F.lit(0)))).when(n.endswith(F.concat(F.lit(" "), head)), F.slice(words, F.lit(1), left)).otherwise(F.array().cast("array<string>")), " "))


def _studio(n: Column) -> Column:
    return _any_of(F.split(n, " "), STUDIOS)


def director_name(line: Column) -> Column:
    """The director that a line names by itself, normalised: "A ... FILM", or a head with a name; empty for other roles, studios and bare heads."""
    n = normal(line)
    t = F.split(n, " ")
    camera = (t[0] == "DIRECTOR") & F.exists(F.slice(t, 2, F.greatest(F.lit(0), F.size(t) - 1)), lambda w: w.startswith("PH"))
    technical = F.element_at(t, -1).isin("DIRECTOR", "DIRECTORS") & _any_of(t, TECHNICAL)
    card, head = F.regexp_extract(n, _CARD, 1), head_in(n, "director")
    rest = F.trim(F.when(n.startswith(F.concat(head, F.lit(" "))), F.substring(n, F.length(head) + 2, F.length(n))).when(n.endswith(F.concat(F.lit(" "), head)), F.substring(n, F.lit(1), F.length(n) - F.length(head))).otherwise(""))
    named = F.when((head != "") & (head != n) & is_name(rest) & ~excluded(rest) & ~_studio(rest), rest).otherwise("")
    return F.coalesce(F.when((n == "") | excluded(n) | camera | technical, "").when(card != "", F.when(is_name(card) & ~_studio(card), card).otherwise("")).otherwise(named), F.lit(""))


def anchored(lines: DataFrame, by: str, pos: str, line: str, most_cast: int = 8) -> DataFrame:
    """by, role, rank and name: the names that stand with the heads of directors, producers and casts, each once a role, the cast's first ones."""
    w = Window.partitionBy(by).orderBy(pos)
    d = lines.select(by, pos, F.trim(F.col(line)).alias("l")).where("l <> ''").withColumn("n", normal(F.col("l")))
    name = is_name(F.col("n")) & ~excluded(F.col("n"))
    d = d.withColumns({"ok": name, "x": excluded(F.col("n")), "card": F.regexp_extract("n", _CARD, 1)})
    d = d.withColumns({f"{c}{k}": F.lag(c, -k).over(w) for k in (1, 2, -1) for c in ("l", "ok")})
    heads = [(r, head_in(F.col("n"), r)) for r in ROLES]
    d = d.where("NOT x").withColumn("shot", (F.col("card") != "") & is_name(F.col("card")) & ~_studio(F.col("card")))
    found = F.when(F.col("shot"), F.struct(F.lit("director").alias("role"), F.lit("").alias("head")))
    for r, h in heads:
        found = found.when(h != "", F.struct(F.lit(r).alias("role"), h.alias("head")))
    d = d.withColumn("at", found).where("at IS NOT NULL")
    words = F.split("l", r"\s+")
    own = beside(F.col("l"), F.col("n"), F.col("at.head"))
    fits = is_name(normal(own)) & ~excluded(normal(own))
    names = (
        F.when(F.col("shot"), F.array(F.array_join(F.slice(words, 2, F.greatest(F.lit(0), F.size(words) - 2)), " ")))
        .when((own != "") & fits, F.array(own))
        .when(F.col("ok1") & F.col("ok2"), F.array("l1", "l2"))
        .when(F.col("ok1"), F.array("l1"))
        .when(F.col("ok-1"), F.array("l-1"))
        .otherwise(F.array().cast("array<string>"))
    )
    out = d.select(by, "at.role", F.posexplode(names).alias("k", "name"), F.col(pos).alias("_pos")).where("name <> ''")
    out = out.groupBy(by, "role", "name").agg(F.min(F.struct("_pos", "k")).alias("o"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy(by, "role").orderBy("o")))
    return out.where((F.col("role") != "cast") | (F.col("rank") <= most_cast)).select(by, "role", "rank", "name")


def guest_head(line: Column) -> Column:
    """Whether a line is a head of guests, but for marks at its ends and an ending of up to four letters."""
    return T.ascii_fold(line).rlike(f"^(?:{_either(GUEST_HEADS)})[a-z]{{0,4}}$")


def boilerplate(line: Column) -> Column:
    """Whether a line is of rights, thanks, places or equipment."""
    return F.upper(F.regexp_replace(T.ascii_fold(line), " +", " ")).rlike(_either(BOILERPLATE)) | line.rlike(f"[{BOILERPLATE_MARKS}]")
