"""Record types, and what a valid record is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names that records may use.
EVENT_STATUS = ("pending", "running", "done", "failed", "partial", "interrupted", "skipped")
JOB_STATUS = ("queued", "running", "done", "failed", "partial", "interrupted")

MEDIA = "media_id string, file_path string, duration_sec double, fps double, width int, height int, created_at timestamp"
TIMELINE_EVENT = "event_id string, media_id string, event_type string, subtype string, start_time double, end_time double, confidence double, status string, source_module string, payload string, evidence_ids array<string>, created_at timestamp"
EVIDENCE = "time_sec double, frame_id string, artifact_path string, text string, bbox array<double>, confidence double, metadata map<string,string>"
RELATION = "entity_a_type string, entity_a_id string, entity_b_type string, entity_b_id string, relation_type string, confidence double, source_signals array<string>, evidence_ids array<string>"
JOB_RUN = "job_id string, media_id string, status string, started_at timestamp, completed_at timestamp, retry_count int, error string, artifacts array<string>"
MODULE_RUN = "run_id string, module string, status string, runtime double, gpu_used boolean, vram int, output_summary map<string,string>, started_at timestamp, completed_at timestamp"
SEGMENT = "media_id string, index int, start double, end double, text string, language string, avg_logprob double, no_speech_prob double, source_chunk_index int, flags array<string>, speaker_id string, channel string, words array<struct<word:string,start:double,end:double,source:string>>"
SCREEN_TEXT = "media_id string, frame string, frame_index int, timestamp double, bbox array<double>, text string, normalized_text string, confidence double, engine string"
SYSTEM_EVENT = "event_id string, ts string, kind string, level string, summary string, module string, media_id string, filename string, job_id string, duration_seconds double, error string, detail string"
EPISODE = "series string, episode int, cast array<string>, crew map<string,array<string>>, guests array<string>"


def _flags(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for c, n in pairs]))


def media_errors() -> Column:
    return _flags(*[(F.col(c) < 0, c) for c in ("duration_sec", "fps", "width", "height")])


def timeline_errors(types: list[str] | None = None) -> Column:
    c = [(F.col("end_time") < F.col("start_time"), "end_time"), (~F.col("confidence").between(0, 1), "confidence"), (F.col("media_id").isNull(), "media_id")]
    return _flags(*c, *([(~F.col("event_type").isin(*types), "event_type")] if types else []))


def evidence_errors() -> Column:
    return _flags((~F.col("confidence").between(0, 1), "confidence"))


def relation_errors() -> Column:
    """A sure relation needs evidence."""
    return _flags((~F.col("confidence").between(0, 1), "confidence"), ((F.col("confidence") >= 0.8) & (F.coalesce(F.size("evidence_ids"), F.lit(0)) < 1), "evidence_ids"))


def run_errors() -> Column:
    return _flags((F.coalesce(F.col("completed_at") < F.col("started_at"), F.lit(False)), "completed_at"), (~F.col("status").isin(*JOB_STATUS), "status"))
