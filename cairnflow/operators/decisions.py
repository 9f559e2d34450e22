"""Rule cascades and verdicts, as ordered when-expressions: the first rule that holds decides."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Phrases that transcribers make up, in the order they are tested.
STOCK_PHRASES = (
    "izlediğiniz için teşekkür ederim", "altyazı m.k.", "altyazı:", "abone olmayı", "abone olun", "yorum yapmayı", "beğen butonuna", "beğen butonuna tıklamayı",
    "bildirim zilini", "kanalımıza abone", "videoyu beğenmeyi", "altyazı m k", "subscribe to", "thanks for watching", "like and subscribe", "thank you",
    "thank you so much", "thank you for watching", "thanks again", "transcript emily beynon", "emily beynon", "subtitles by", "subtitled by", "subs by",
    "captions by", "captioned by", "translated by", "translation by", "amara org", "english subtitles", "altyazı çevirisi",
)
# Short phrases of other languages that pass as the main one, in the order they are tested.
FOREIGN_PHRASES, FOREIGN_WORDS = ("and i m", "caralho faul", "caralho fauri", "i got time", "je ne sais pas", "merci", "tall guy", "tchau lugar"), 5
# Confidence that a screen text of each type needs, and what other types need.
TYPE_FLOORS, OTHER_FLOOR = {"scroll_credit": 0.50, "card": 0.75, "intertitle": 0.75, "kj": 0.85, "scene_text": 0.90}, 0.50


def flags(*pairs: tuple[Column, str]) -> Column:
    """The names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]))


def first_reason(*pairs: tuple[Column, Column | str]) -> Column:
    """The reason of the first condition that holds; null if none."""
    return F.coalesce(*[F.when(c, F.lit(r) if isinstance(r, str) else r) for c, r in pairs])


@dataclass(frozen=True)
class SegmentRules:
    no_speech_hard: float = 0.6
    logprob_hard: float = -1.0
    min_tokens: int = 3
    no_speech_flag: float = 0.4
    logprob_flag: float = -0.8
    logprob_short: float = -1.15
    short_tokens: int = 5
    languages: tuple[str, ...] = ("tr", "en")
    repeat_run: int = 20
    longest: int = 80
    drop_stock: bool = True
    drop_scripts: bool = True
    drop_phrases: bool = True
    drop_repeats: bool = True


def judge_segments(rows: DataFrame, rules: SegmentRules = SegmentRules()) -> DataFrame:
    """keep, drop_reason and flags of segments (text, no_speech, logprob, language): the first rule that holds drops one, and names its
    flag; what is kept is flagged by its signals."""
    t = F.trim(F.coalesce("text", F.lit("")))
    r = rows.withColumns({"_w": T.words(t), "_q": T.quality_text(t)})
    r = r.withColumns({"_run": T.repeat_run(t, F.col("_w"), rules.repeat_run), "_n": F.size("_w"), "_long": T.longest_over(t, F.col("_w"), rules.longest), "_script": T.foreign_script(t), "_stock": T.holds_any(F.col("_q"), STOCK_PHRASES)})
    r = r.withColumn("_phrase", F.when(F.size(T.words("_q")) <= FOREIGN_WORDS, T.holds_any(F.col("_q"), FOREIGN_PHRASES)))
    native = F.col("language").isNull() | (F.col("language") == "tr")
    on = lambda switch, c: c if switch else F.lit(False)
    drops = (
        (~t.rlike(r"[\p{L}\p{N}]"), "no_alnum", None),
        (on(rules.drop_stock, F.col("_stock").isNotNull()), F.concat(F.lit("stock_artifact:"), "_stock"), "stock_artifact"),
        (on(rules.drop_scripts, native & F.col("_script").isNotNull()), F.concat(F.lit("foreign_script_artifact:"), "_script"), "foreign_script_artifact"),
        (on(rules.drop_phrases, native & F.col("_phrase").isNotNull()), F.concat(F.lit("short_foreign_phrase_artifact:"), "_phrase"), "foreign_phrase_artifact"),
        (on(rules.drop_repeats, F.coalesce(F.col("_run.run") >= rules.repeat_run, F.lit(False))), F.concat(F.lit("repetition_collapse:"), "_run.token", F.lit(":run="), F.col("_run.run").cast("string")), "repetition_collapse"),
        (F.col("_long").isNotNull(), F.concat(F.lit("long_token_artifact:length="), F.col("_long").cast("string")), "long_token_artifact"),
        ((F.col("logprob") < rules.logprob_short) & (F.col("_n") <= rules.short_tokens), "very_low_logprob_short_text", "very_low_logprob"),
        ((F.col("no_speech") > rules.no_speech_hard) & (F.col("logprob") < rules.logprob_hard) & (F.col("_n") < rules.min_tokens), "multi_signal_low_quality", None),
    )
    f = flags((F.col("_stock").isNotNull() if not rules.drop_stock else F.lit(False), "stock_artifact"), (F.col("no_speech") > rules.no_speech_flag, "high_no_speech_prob"), (F.col("logprob") < rules.logprob_flag, "low_logprob"), (F.col("language").isNotNull() & ~F.col("language").isin(*rules.languages), "unexpected_language"))
    f = F.when(F.size(f) > 0, F.concat(f, F.array(F.lit("low_confidence")))).otherwise(f)
    none = F.array().cast("array<string>")
    why = F.coalesce(*[F.when(c, F.array(F.lit(n)) if n else none) for c, _, n in drops])
    r = r.withColumn("drop_reason", first_reason(*[(c, reason) for c, reason, _ in drops])).withColumn("keep", F.col("drop_reason").isNull())
    return r.withColumn("flags", F.when(F.col("keep"), f).otherwise(why)).drop("_w", "_q", "_run", "_n", "_long", "_script", "_stock", "_phrase")


def result_safety(run: Column, token: Column, longest: Column, words: Column, seconds: Column, expected_end: Column, last_end: Column, max_run: int = 20, max_token: int = 80, max_rate: float = 5.0, max_tail: float = 3.0, max_tail_ratio: float = 0.25) -> Column:
    """Why a whole transcript isn't safe; null if it is."""
    want, have = F.greatest(F.lit(0.0), expected_end), F.greatest(F.lit(0.0), F.coalesce(last_end, F.lit(0.0)))
    tail = F.greatest(F.lit(0.0), want - have)
    allowed = F.when(want > 0, F.least(F.lit(max_tail), want * 0.15)).otherwise(max_tail)
    rate = words / seconds
    return first_reason(
        (run >= max_run, F.concat(F.lit("repetition_collapse:"), token, F.lit(":run="), run.cast("string"))),
        (longest > max_token, F.concat(F.lit("long_token_artifact:length="), longest.cast("string"))),
        ((seconds > 0) & (rate > max_rate), F.format_string("word_density_anomaly:wps=%.2f", rate)),
        (expected_end.isNotNull() & (tail >= allowed) & F.when(want > 0, tail / want >= max_tail_ratio).otherwise(False), F.format_string("tail_gap_uncovered:gap=%.2fs", tail.cast("double"))),
    )


def type_floor(kind: Column, floors: dict[str, float] = TYPE_FLOORS, other: float = OTHER_FLOOR) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in floors.items() for x in kv])[kind], F.lit(other))


def event_errors(start: Column, end: Column, confidence: Column, kind: Column, kinds: list[str]) -> Column:
    """What is wrong with an event."""
    return flags((start.isNull() | (start < 0), "start"), (end.isNull() | (end < start), "end"), (confidence.isNull() | ~confidence.between(0, 1), "confidence"), (kind.isNull() | ~kind.isin(*kinds), "type"))


def severity(grave: Column, mild: Column, harmless: list[str]) -> Column:
    """Tier of two arrays of faults: any grave one sends to control, a mild one that isn't harmless to review."""
    return F.when(F.size(grave) > 0, "CONTROL").when(F.size(F.array_except(mild, F.array(*[F.lit(h) for h in harmless]))) > 0, "REVIEW").otherwise("CLEAN")


def text_motion(dx: Column, dy: Column, samples: Column, dx_steady: Column, dy_steady: Column, layout_ok: Column) -> Column:
    return F.when(samples < 2, "unknown").when((dy >= 0.55) & (dy >= dx * 1.35) & (dy_steady >= 0.55), "vertical_scroll").when((dx >= 0.55) & (dx >= dy * 1.35) & (dx_steady >= 0.55), "horizontal_crawl").when((F.greatest(dx, dy) < 0.35) & layout_ok, "static_card").otherwise("mixed")


def layout_class(ok: Column, y_center: Column, cover_y: Column, cover_x: Column, columns: Column, valley: Column) -> Column:
    return F.when(~ok, "unknown").when((y_center > 0.70) & (cover_y < 0.38), "lower_third").when((columns >= 2) & (valley >= 0.055), "multi_column").when(cover_x < 0.72, "center_single_column").otherwise("unknown")


def output_quality(black: Column, white: Column, edges: Column, parts: Column, records: Column, text_area: Column, contrast: Column, confidence: Column) -> Column:
    return F.coalesce(
        F.when(black > 0.95, "BROKEN_BLACK"),
        F.when((white > 0.95) | ((records == 0) & (edges < 0.01)), "BROKEN_EMPTY"),
        F.when(records == 0, "BROKEN_NO_TEXT"),
        F.when((edges > 0.15) & (text_area < 0.10), "BROKEN_BACKGROUND_LEAK"),
        F.when((parts < 5) & (records < 3) & (edges > 0.05), "BROKEN_SMEAR"),
        F.when(contrast < 15, "BROKEN_LOW_CONTRAST"),
        F.when(confidence < 0.4, "SUSPICIOUS"),
        F.lit("OK"),
    )


def language_decision(best: Column, second: Column, language: Column, floor: float, margin: float) -> Column:
    """unknown under the floor, mixed within the margin of the next, else the language."""
    return F.when(language.isNull() | best.isNull() | (best < floor), "unknown").when(best - second < margin, "mixed").otherwise(language)


def swap_decision(no_speech: Column, has_other: Column, seconds: Column, own: Column, other: Column, floor: float, longest: float, margin: float) -> Column:
    return F.when(no_speech <= floor, "keep").when(~has_other | other.isNull(), "review").when(seconds > longest, "review").when(other >= own + margin, "swap").otherwise("review")


def empty_field(policy_na: Column, filled: Column, covered: Column, verdict: Column, legible: Column) -> Column:
    """Why a field is empty."""
    return F.when(policy_na, "NOT_APPLICABLE").when(filled, "NOT_EMPTY").when(~covered, "EVIDENCE_INSUFFICIENT").when(verdict == "has_text", "MISSED_TEXT").when(verdict == "role_absent", "ROLE_ABSENT").when((verdict == "no_text") & (legible == "high"), "SOURCE_ABSENT").otherwise("SOURCE_UNREADABLE")


def job_status(safe: Column, speakers: Column, alignment: Column) -> Column:
    return F.when((safe == F.lit(False)) | (speakers == "failed") | alignment.isin("failed", "degraded"), "partial").otherwise("done")


def cross_verdict(overlap: Column, director: Column) -> Column:
    """Locked by three shared names, or two and the director."""
    return F.when(overlap >= 3, "LOCKED").when((overlap >= 2) & director, "LOCKED").when(overlap >= 1, "CANDIDATE").otherwise("NONE")


def start_verdict(truth: Column, found: Column, tolerance: int) -> Column:
    """Of a start found for a true one; -1 or null is none."""
    has, got = truth >= 0, found.isNotNull() & (found >= 0)
    return F.when(~has & ~got, "AVOIDED_FP").when(~has & got, "FALSE_POSITIVE").when(~got, "MISS").when(F.abs(found - truth) <= tolerance, "CORRECT").when(found < truth, "EARLY").otherwise("LATE")


def pick_spelling(rows: DataFrame, cluster: str, name: str, n: str, known: Column, garbled: Column, order: str) -> DataFrame:
    """The spelling of each cluster: without digits, most seen, known, not garbled, first."""
    key = F.struct(F.when(F.col(name).rlike(r"\d"), 1).otherwise(0), -F.col(n), F.when(known, 0).otherwise(1), F.when(garbled, 1).otherwise(0), F.col(order))
    return rows.groupBy(cluster).agg(F.min_by(name, key).alias("canonical"), F.sum(n).alias("votes"))


def membership(seen: Column, episodes: Column) -> Column:
    """Standing of a member seen in so many episodes of all."""
    return F.when(seen == episodes, "ACTIVE").when((episodes >= 3) & (seen == episodes - 1), "WEAK").otherwise("CANDIDATE")


def field_diff(old: DataFrame, new: DataFrame, key: str, field: str, value: str, gated: list[str]) -> DataFrame:
    """Fields that differ between two versions; blocked where a gated one goes empty."""
    a, b = old.select(key, field, F.col(value).alias("was")), new.select(key, field, F.col(value).alias("now"))
    d = a.join(b, [key, field], "full").where(~F.col("was").eqNullSafe(F.col("now")))
    had, has = F.coalesce("was", F.lit("")) != "", F.coalesce("now", F.lit("")) != ""
    return d.withColumn("blocked", F.col(field).isin(*gated) & had & ~has)


def seal(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def channel_choice(rows: DataFrame, by: str) -> DataFrame:
    """The channel (role, language, tr_votes, confidence, channel) of each key by ranked rules."""
    speech = F.col("role") == "speech"
    rank = F.when(speech & (F.col("language") == "tr"), 0).when(speech, 1).when(F.col("language").isNotNull() & (F.col("tr_votes") > 0), 2).when(F.col("language").isNotNull(), 3).otherwise(4)
    w = Window.partitionBy(by).orderBy(rank, F.when(rank == 2, -F.col("tr_votes")), F.when(rank == 3, -F.col("confidence")), "channel")
    return rows.withColumn("rule", rank).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
