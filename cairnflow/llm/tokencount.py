"""Token counts of whole texts, with overlap resynchronisation for huge documents.

A text over ``huge`` characters is cut into overlapping chunks.  Each chunk is encoded with offsets; the streams of two
neighbours are spliced at a boundary in their overlap at which both start a token and agree up to the next one, and which is
stable.  For a ``.json`` tokenizer whose pre-tokenizer splits at white space that is the end of a gap between two words; for a
sentencepiece ``.model`` none of whose pieces holds white space but at its start it is a single space between two plain letters:
neither normalising nor the best segmentation on one side depends on the other.  If the overlap holds no such boundary (one
unbroken run of characters) it is doubled, up to the whole rest of the text.  Memory is bound by a chunk, not by the document.
Tokenizers for which no boundary is proven stable get their whole texts.

Shorter texts go through the library whole, or by distinct piece (``wordbpe``), with equal results.

Scale: a map over the scan with no shuffle; the columns that aren't read are pruned.

Defined results: a null text counts as empty and has no tokens; a null doc_id stays null; repeated rows each get a row; an
empty table gives an empty result; other columns are ignored and may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column
from .wordbpe import WordEncoder, default_path, encoder

HUGE, CHUNK, OVERLAP = 24_000, 16_384, 256
#: Plain spaces and line feeds, white space to every library here; a text is cut right before one.
_STABLE = re.compile(r"(?<=[^ \n])[ \n]+(?=[^ \n])")
_BETWEEN = re.compile(r"(?<=[A-Za-z.,]) (?=[A-Za-z])")


class SpaceCut:
    """Chunks by a WordEncoder: ids, token starts, and the positions where a cut is proven stable."""

    def __init__(self, enc: WordEncoder):
        self.enc, self.proven = enc, enc.by_piece

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """ids, and for each the character at which it starts."""
        e = self.enc.lib.encode(text, add_special_tokens=False)
        return np.array(e.ids, dtype="<u4"), np.array([o[0] for o in e.offsets], dtype=np.int64)

    def spots(self, text: str, a: int, b: int) -> list[int]:
        return [m.end() for m in _STABLE.finditer(text, a, b)]


class PieceCut:
    """The same for a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.lib.get_piece_size()
        self.proven = all("\u2581" not in self.lib.id_to_piece(i).lstrip("\u2581") for i in range(n))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        e = self.lib.encode(text, return_type="offset_mapping")
        return np.array(e["ids"], dtype="<u4"), np.array([o[0] for o in e["offsets"]], dtype=np.int64)

    def count(self, text: str) -> int:
        return len(self.lib.encode(text, num_threads=1))

    def spots(self, text: str, a: int, b: int) -> list[int]:
        return [m.start() for m in _BETWEEN.finditer(text, a, b)]


def splice(cut: SpaceCut | PieceCut, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """ids of a whole text from overlapping chunks."""
    if not cut.proven or len(text) <= chunk:
        return cut.encode(text)[0]
    out, at = [], 0
    ids, starts = cut.encode(text[:chunk])
    end = min(chunk, len(text))
    while end < len(text):
        wide = overlap
        while True:
            back = max(at, end - wide)
            ahead_end = min(len(text), back + max(chunk, 2 * wide))
            next_ids, next_starts = cut.encode(text[back:ahead_end])
            where = boundary(cut, text, back, end, starts + at, ids, next_starts + back, next_ids)
            if where is not None or back == at:
                break
            wide *= 2
        if where is None:  # no boundary in the whole chunk: it grows
            end = min(len(text), end + max(chunk, wide))
            ids, starts = cut.encode(text[at:end])
            continue
        out.append(ids[: np.searchsorted(starts + at, where)])
        skip = int(np.searchsorted(next_starts + back, where))
        ids, starts, at, end = next_ids[skip:], next_starts[skip:] + back - where, where, ahead_end
    out.append(ids)
    return np.concatenate(out)


def boundary(cut: SpaceCut | PieceCut, text: str, back: int, end: int, left: np.ndarray, left_ids: np.ndarray, right: np.ndarray, right_ids: np.ndarray) -> int | None:
    """The middle one of the stable positions in (back, end) at which both streams start a token and agree up to the next stable position."""
    spots = cut.spots(text, back, end)
    both = [p for p, q in zip(spots, spots[1:]) if _same(p, q, left, left_ids, right, right_ids)]
    return both[len(both) // 2] if both else None


def _same(p: int, q: int, left: np.ndarray, left_ids: np.ndarray, right: np.ndarray, right_ids: np.ndarray) -> bool:
    a, b = np.searchsorted(left, [p, q])
    c, d = np.searchsorted(right, [p, q])
    return a < b and left[a] == p and right[c : c + 1].tolist() == [p] and np.array_equal(left_ids[a:b], right_ids[c:d])


def counts(texts: list[str | None], path: str, huge: int = HUGE) -> list[int]:
    if path.endswith(".model"):
        pieces = _pieces(path)
        return [pieces.count(t or "") if not t or len(t) <= huge else len(splice(pieces, t)) for t in texts]
    enc = encoder(path)
    cut = SpaceCut(enc)
    short = enc.packed_many([t if t and len(t) <= huge else None for t in texts])
    return [len(s) // 4 if not t or len(t) <= huge else len(splice(cut, t)) for s, t in zip(short, texts)]


_MODELS: dict[str, PieceCut] = {}


def _pieces(path: str) -> PieceCut:
    if path not in _MODELS:
        _MODELS[path] = PieceCut(path)
    return _MODELS[path]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 2048, doc_id: str = "doc_id", text: str = "text", huge: int = HUGE) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for each row."""
    path = tokenizer or default_path()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            texts = column(b, "text").to_pylist()
            n = np.array(counts(texts, path, huge), dtype=np.int64)
            size = np.array([len(t.encode()) if t else 0 for t in texts], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(size), pa.array(n), pa.array(n > limit)], schema=SCHEMA)

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
