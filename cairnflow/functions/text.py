"""Text normalisers and tests, as column expressions that stay in the JVM.

Each normaliser is a function of its own: they differ in case, in what becomes a space and in trimming, and results depend on it.
Turkish letters are translated before lower(), since lower('İ') gives two characters.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Turkish letters and their plain forms.
TR_FROM, TR_TO = "İIıŞşĞğÜüÖöÇç", "iiissgguuoocc"
TR_UPPER_FROM, TR_UPPER_TO = "İıŞşĞğÜüÖöÇç", "IISSGGUUOOCC"
# Latin letters with marks and their plain forms, lower case.
MARKED, PLAIN = "àáâãäåāăąçćĉċčďđèéêëēĕėęěĝğġģĥħìíîïĩīĭįıĵķĺļľłñńņňòóôõöøōŏőŕŗřśŝşšţťŧùúûüũūŭůűųŵýÿŷźżž", "aaaaaaaaacccccddeeeeeeeeegggghhiiiiiiiiijkllllnnnnooooooooorrrssssttt" + "uuuuuuuuuuwyyyzzz"
# Scripts that mark a foreign reading, in the order they are tested.
SCRIPTS = ("Arabic", "Han", "Cyrillic", "Devanagari", "Hangul", "Hebrew", "Hiragana", "Katakana", "Thai")


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def tr_fold(c: Column | str) -> Column:
    """Turkish letters to plain ones, lower case, trimmed."""
    return F.trim(F.lower(F.translate(_text(c), TR_FROM, TR_TO)))


def ascii_fold(c: Column | str) -> Column:
    """tr_fold, marks dropped, every other character a space of its own, trimmed."""
    low = F.lower(F.translate(_text(c), TR_FROM, TR_TO))
    return F.trim(F.regexp_replace(F.translate(low, MARKED, PLAIN), "[^a-z0-9 ]", " "))


def cast_fold(c: Column | str) -> Column:
    """Letters and digits in plain lower case, runs of anything else one space; dotless i counts as i."""
    low = F.lower(F.translate(_text(c), "İI", "ii"))
    return F.trim(F.regexp_replace(F.translate(low, MARKED, PLAIN), "[^a-z0-9]+", " "))


def upper_key(c: Column | str) -> Column:
    """Plain upper case, trimmed; other characters stay."""
    return F.trim(F.upper(F.translate(F.lower(F.translate(_text(c), TR_UPPER_FROM, TR_UPPER_TO)), MARKED, PLAIN)))


def quality_text(c: Column | str) -> Column:
    """Lower case without marks, anything that isn't a letter, digit or underscore a space, runs of space one."""
    low = F.lower(F.translate(_text(c), "İI", "ii"))
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(low, MARKED, PLAIN), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def screen_text(c: Column | str) -> Column:
    """Upper case A-Z and 0-9 after Turkish folds, all else one space."""
    return F.trim(F.regexp_replace(F.upper(F.translate(_text(c), TR_UPPER_FROM, TR_UPPER_TO)), "[^A-Z0-9]+", " "))


def plain_upper(c: Column | str) -> Column:
    """Marks dropped, upper case, runs of space one; the dotless i stays a letter of its own until it is upper case."""
    low = F.lower(F.translate(_text(c), "İ", "I"))
    return F.trim(F.regexp_replace(F.upper(F.translate(low, MARKED, PLAIN)), r"\s+", " "))


def tr_upper(c: Column | str) -> Column:
    """Turkish upper case (i to İ, ı to I); letters of other scripts than Latin are dropped."""
    latin = F.regexp_replace(_text(c), r"[\p{L}&&[^\p{IsLatin}]]", "")
    return F.upper(F.translate(latin, "ıi", "Iİ"))


def tokens(c: Column, least: int = 1) -> Column:
    """Space-separated tokens of at least so many characters."""
    return F.filter(F.split(c, " "), lambda t: F.length(t) >= least)


def words(c: Column | str) -> Column:
    return F.filter(F.split(_text(c), r"\s+"), lambda t: t != "")


def snippet(text: Column | str, needle: Column | str, radius: int = 90) -> Column:
    """The text around the first place of needle after folding; the text's start where it isn't found."""
    t = _text(text)
    n = F.lit(needle) if isinstance(needle, str) else needle
    at = F.position(F.lower(n), F.lower(t)) - 1
    lo = F.greatest(F.lit(0), at - radius)
    hi = F.least(F.length(t), at + F.length(n) + radius)
    cut = F.concat(F.when(lo > 0, "...").otherwise(""), F.trim(F.substring(t, lo + 1, hi - lo)), F.when(hi < F.length(t), "...").otherwise(""))
    return F.when(at < 0, F.trim(F.substring(t, F.lit(1), F.lit(2 * radius)))).otherwise(cut)


def longest_token(c: Column | str) -> Column:
    return F.aggregate(words(c), F.lit(0), lambda a, t: F.greatest(a, F.length(t)))


def longest_repeat(toks: Column) -> Column:
    """struct(run, token): the longest run of equal neighbours, the first of equals."""
    start = F.struct(F.lit("").alias("prev"), F.lit(0).alias("cur"), F.lit(0).alias("run"), F.lit("").alias("token"))

    def step(a: Column, t: Column) -> Column:
        cur = F.when(t == a["prev"], a["cur"] + 1).otherwise(1)
        more = cur > a["run"]
        return F.struct(t.alias("prev"), cur.alias("cur"), F.when(more, cur).otherwise(a["run"]).alias("run"), F.when(more, t).otherwise(a["token"]).alias("token"))

    return F.aggregate(toks, start, step, lambda a: F.struct(a["run"], a["token"]))


def repeat_run(text: Column, toks: Column, least: int) -> Column:
    """longest_repeat of the tokens, compared without case, marks and signs, where a run has at least ``least``; else null.  A
    back-reference over the text finds whether there is one, so that few texts have their tokens folded one by one."""
    key = lambda w: F.coalesce(F.nullif(F.translate(quality_text(w), " ", ""), F.lit("")), F.lower(w))
    low = F.lower(F.translate(text, "İI", "ii"))
    stripped = F.regexp_replace(F.regexp_replace(F.translate(low, MARKED, PLAIN), r"\s+", "\n"), r"[^\p{L}\p{N}_\n]+", "")
    some = stripped.rlike(rf"(?:^|\n)([^\n]*+)(?:\n\1(?=\n|\z)){{{least - 1}}}")
    pairs = F.transform(toks, lambda w: F.struct(key(w).alias("key"), w.alias("token")))
    start = F.struct(F.lit("").alias("prev"), F.lit(0).alias("cur"), F.lit("").alias("first"), F.lit(0).alias("run"), F.lit("").alias("token"))

    def step(a: Column, x: Column) -> Column:
        same = x["key"] == a["prev"]
        cur = F.when(same, a["cur"] + 1).otherwise(1)
        first = F.when(same, a["first"]).otherwise(x["token"])
        more = cur > a["run"]
        return F.struct(x["key"].alias("prev"), cur.alias("cur"), first.alias("first"), F.when(more, cur).otherwise(a["run"]).alias("run"), F.when(more, first).otherwise(a["token"]).alias("token"))

    return F.when(some, F.aggregate(pairs, start, step, lambda a: F.struct(a["run"], a["token"])))


def longest_over(text: Column, toks: Column, most: int) -> Column:
    """The length of the longest token where one is longer than ``most``; else null."""
    return F.when(text.rlike(rf"\S{{{most + 1}}}"), F.aggregate(toks, F.lit(0), lambda a, w: F.greatest(a, F.length(w))))


def quality_key(text: str) -> str:
    """quality_text of a constant."""
    low = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c)).replace("ı", "i")
    return " ".join(re.sub(r"[^\w\s]", " ", low).split())


def holds_any(c: Column, phrases: tuple[str, ...]) -> Column:
    """The first of phrases that a quality_text holds, folded alike; null if none."""
    return F.coalesce(*[F.when(c.contains(quality_key(p)), F.lit(p)) for p in phrases])


def foreign_script(c: Column | str) -> Column:
    """The first of SCRIPTS that has a letter in the text, lower case; null if none has."""
    t = _text(c)
    some = t.rlike("[" + "".join(rf"\p{{Is{s}}}" for s in SCRIPTS) + "]")  # one pass for the many texts that have none
    return F.when(some, F.coalesce(*[F.when(t.rlike(rf"\p{{Is{s}}}"), s.lower()) for s in SCRIPTS]))


def dominant_script(c: Column | str) -> Column:
    """The script other than Latin with most letters, or latin where there is none; the first of SCRIPTS wins a tie."""
    t = _text(c)
    counts = F.array(*[F.struct(F.regexp_count(t, F.lit(rf"\p{{Is{s}}}")).alias("n"), F.lit(-k).alias("k"), F.lit(s.lower()).alias("s")) for k, s in enumerate(SCRIPTS)])
    top = F.array_max(counts)
    return F.when(top["n"] > 0, top["s"]).otherwise("latin")


def sentences(c: Column | str, least: int = 25) -> Column:
    """Sentences of at least so many characters, runs of space one."""
    parts = F.split(F.translate(_text(c), "\n", " "), r"(?<=[.!?…])\s+")
    return F.transform(F.filter(parts, lambda s: F.length(F.trim(s)) >= least), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))


def labels_of(codes: Column, labels: dict[str, str], k: int = 2, sep: str = r"\|") -> Column:
    """The first k distinct labels of a delimited list of codes, in order; unknown codes are dropped, null if none is known."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    known = F.array_distinct(F.array_compact(F.transform(F.split(codes, sep), lambda q: table[F.trim(q)])))
    return F.when(F.size(known) > 0, F.array_join(F.slice(known, 1, k), " / "))


def without_titles(name: Column, titles: list[str]) -> Column:
    """A name without leading titles, if at least two words are left."""
    one = "(?:" + "|".join(titles) + r")\.?"
    cut = F.regexp_replace(name, rf"(?i)^(?:{one}\s*)+(?=\S)", "")
    return F.when(F.size(words(cut)) >= 2, cut).otherwise(name)


def cache_key(*parts: Column) -> Column:
    """SHA-1 of the parts as JSON."""
    return F.sha1(F.to_json(F.struct(*[p.alias(f"p{k}") for k, p in enumerate(parts)])))
