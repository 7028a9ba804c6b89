"""Quality rules with compression bands.

Base rules count words, symbols, repeated lines and words in repeated three-word windows. The method on top compresses the whole
document and each fixed chunk with zstandard: a ratio (compressed bytes by bytes) under the band's lower limit is repetitive text, one
over its upper limit is incompressible (random or encoded) text. Limits depend on length, as short input neither compresses well nor
says much. Hex digits (0.51 to 0.53 from 2 KB on) compress about as well as dense prose, so the upper limits can't reject them.

Defined results: null text is text without words (zero counts, base_failed); empty and blank texts likewise. Repeated rows and ties each
get their own row; other columns are kept unless the operator's own names clash with them, which replaces them. Empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh, ready, session

SYMBOLS = "#*$%&|<>"
_BLANK = " \t\n\v\f\r"
CHUNK_BYTES = 8192


@dataclass(frozen=True)
class Band:
    """Limits for inputs of fewer than below bytes (None: any)."""

    below: int | None
    low: float
    high: float


#: Whole documents, by bytes. Fixed frame and entropy-table costs dominate short input: hence wide limits there. Upper limits lie between
#: the largest ratio measured of prose (sf0.1: 0.75, 0.70, 0.60, 0.53, 0.48 in the bands from 256 bytes) and, at the bands' ends, the least
#: of base64 in lines (0.85, 0.80, 0.77, 0.76, 0.75), of base32 from 2 KB on (0.64, 0.63) and of uniform CJK characters (0.84, 0.78, 0.75, 0.73, 0.72).
#: Below 256 bytes, by 4,000 windows of prose each (sf0.1; least, largest) against base64 (least) and one word over and over (largest):
#: under 128 bytes 0.69, 1.14 against 1.02 and 0.31, where only repetition can be told; under 192 0.63, 0.94 (99.9 %: 0.89) against 0.95 and
#: 0.16; under 256 0.61, 0.85 against 0.90 and 0.11.
DOCUMENT_BANDS = (Band(128, 0.40, 1.15), Band(192, 0.30, 0.945), Band(256, 0.22, 0.88), Band(512, 0.18, 0.82), Band(1024, 0.14, 0.75), Band(2048, 0.10, 0.68), Band(4096, 0.10, 0.63), Band(65536, 0.06, 0.60), Band(None, 0.04, 0.60))
#: Fixed chunks of CHUNK_BYTES (the last one shorter), by bytes: a short last one as a document of its length.
CHUNK_BANDS = (*DOCUMENT_BANDS[:6], Band(4096, 0.06, 0.63), Band(None, 0.04, 0.60))
#: A document fails when more than this share of its chunks' bytes is outside the chunk bands.
MAX_BAD_CHUNK_SHARE = 0.1
LEVEL = 3

COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, bad_chunk_share double, kept boolean"


def repeated_words(words: Sequence[bytes]) -> int:
    """Words covered by three-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    n = len(number)
    pairs = ids[:-1] * n + ids[1:]
    if n > 1 << 20:  # keeps the window's number within 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * n + ids[2:]
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(windows, twice)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    words = text.encode().split()  # bytes.split() splits at the six ASCII white-space characters and no others
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    repeat = repeated_words(words)
    return n, len(text) - sum(map(text.count, _BLANK)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat, n < 50 or 100 * repeat > 50 * n


def outside(size: int, compressed: int, bands: Sequence[Band]) -> bool:
    band = next(b for b in bands if b.below is None or size < b.below)
    return size > 0 and not band.low <= compressed / size <= band.high


def compression(data: bytes, compress) -> tuple[float, float, bool]:
    """Whole ratio, share of bytes in chunks outside their band, and whether both levels accept the text."""
    if not data:
        return 0.0, 0.0, True
    whole = len(compress(data))
    bad = 0
    if len(data) > CHUNK_BYTES:
        for k in range(0, len(data), CHUNK_BYTES):
            chunk = data[k : k + CHUNK_BYTES]
            bad += len(chunk) * outside(len(chunk), len(compress(chunk)), CHUNK_BANDS)
    share = bad / len(data)
    return whole / len(data), share, not outside(len(data), whole, DOCUMENT_BANDS) and share <= MAX_BAD_CHUNK_SHARE


def quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the columns of COLUMNS added: base counts, whole ratio, share of bytes in bad chunks, and the verdict."""
    ready(session(docs))
    added = [c.split()[0] for c in COLUMNS.split(", ")]
    kept = [c for c in docs.columns if c.lower() not in added]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").alias(fresh(docs, "__text")))
    types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            out = []
            for text in batch.column(len(kept)).to_pylist():
                text = text or ""
                base = base_counts(text)
                ratio, share, good = compression(text.encode(), compress)
                out.append((*base, ratio, share, good and not base[-1]))
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], [*kept, *added])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), COLUMNS])
    return rows.mapInArrow(judge, schema)
