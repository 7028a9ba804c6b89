"""Language identification by language-bitmask n-gram filters.

Learning finds, for every language, the letter n-grams that occur in at least MIN_SHARE of its sampled documents. They go into one
bit-sliced Bloom filter: each of SLOTS positions holds a bitmask of languages (a byte plane per eight languages), and the AND of the
masks at an n-gram's HASHES positions is the set of all languages that contain it. A text's n-grams give a mask each; per-language
popcounts, corrected for the false positives that a language's fill of the filter implies, decide.

The filter's size is a parameter, so the model is bounded whatever it was learned from. Fitting reads at most about SAMPLE_ROWS rows per
language, chosen by a hash of doc_id; prediction covers every whole text.

Defined results: ``und`` with score 0 for null text, text without a letter, or no learned language; text with letters but without any
known n-gram gets the most frequent learned language with score 0. Equal counts go to the more frequent language, then by name. Rows
without doc_id or lang don't teach. Other columns are kept unless they clash with the result names, which replace them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh, ready, session

SIZES = (3, 4)
SLOTS_LOG2 = 21
HASHES = 2
SAMPLE_ROWS = 4000
MIN_SHARE = 0.02
#: N-grams that learning holds at a time; it bounds memory only.
HELD_GRAMS = 1_000_000
#: A text whose best language explains less than this share of its n-grams is in no learned language.
MIN_COVERAGE = 0.15
_MULTIPLIER, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Which code points of the first plane are letters."""
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


def grams(text: str) -> np.ndarray:
    """Mixed 64-bit hashes of a text's n-grams of lower-case letters; runs of other characters count as one space."""
    cp = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[np.minimum(cp, 0xFFFF)] | (cp > 0xFFFF)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:] & ~letter[:-1] & ~np.concatenate(([False], letter[:-2]))
    c = np.where(letter, cp, 32)[keep].astype(np.uint64)
    out = []
    for n in SIZES:
        if len(c) >= n:
            h = np.full(len(c) - n + 1, n, np.uint64)
            for k in range(n):
                h = h * _MULTIPLIER + c[k : len(c) - n + 1 + k]
            h ^= h >> np.uint64(32)
            h *= _MIX
            out.append(h ^ (h >> np.uint64(29)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def places(h: np.ndarray, bits: int = SLOTS_LOG2) -> list[np.ndarray]:
    """The HASHES slots of each n-gram."""
    step = (64 - bits) // max(1, HASHES - 1)
    return [((h >> np.uint64(min(step * k, 64 - bits))) & np.uint64((1 << bits) - 1)).astype(np.int64) for k in range(HASHES)]


@dataclass(frozen=True)
class LanguageModel:
    """languages by falling frequency; planes of one byte per slot; false-positive rates."""

    languages: tuple[str, ...]
    planes: np.ndarray
    rates: np.ndarray
    bits: int = SLOTS_LOG2

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """Corrected counts per language, and the number of n-grams."""
        h = grams(text)
        at = places(h, self.bits)
        found = []
        for plane in self.planes:
            masks = plane[at[0]]
            for more in at[1:]:
                masks = masks & plane[more]
            found.append(np.bincount(masks, minlength=256) @ _BITS)
        raw = np.concatenate(found)[: len(self.languages)]
        return np.maximum(0.0, (raw - len(h) * self.rates) / (1 - self.rates)), len(h)

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score (best against best plus second) and coverage (share of n-grams that the best explains)."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0
        counts, n = self.counts(text)
        best = int(np.argmax(counts))
        top = float(counts[best])
        if top <= 0:
            return self.languages[best], 0.0, 0.0
        second = float(np.max(np.delete(counts, best))) if len(counts) > 1 else 0.0
        return self.languages[best], top / (top + second), min(1.0, top / n)


#: Bits of each byte value: the popcount of mask counts per language.
_BITS = np.array([[value >> bit & 1 for bit in range(8)] for value in range(256)], np.int64)


#: Labels that a model learns at most.
MAX_LANGUAGES = 512


def held_out(doc_id: Column) -> Column:
    """Documents that only test: crc32 of the id's text is 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, min_share: float = MIN_SHARE, max_languages: int = MAX_LANGUAGES) -> LanguageModel:
    """Learns from text and lang of rows with both; the caller leaves out what must not teach. Sampling is by hash of doc_id.

    Of more labels than max_languages, the most frequent ones are learned: dirty labels cannot grow the model.
    """
    spark = session(docs)
    ready(spark)
    known = docs.filter("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text", "lang")
    counted = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang")
    sizes = {r["lang"]: r["n"] for r in counted.limit(max_languages).collect()}  # a row per language
    languages = tuple(sorted(sizes, key=lambda x: (-sizes[x], x)))
    bits = SLOTS_LOG2
    planes = np.zeros(((len(languages) + 7) // 8 or 1, 1 << bits), np.uint8)
    if not languages:
        return LanguageModel((), planes, np.zeros(0), bits)
    number = {x: k for k, x in enumerate(languages)}
    keep = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample_rows / sizes[lang]))])
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.try_element_at(keep, F.col("lang")) * (1 << 20)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list] = {}
            held = 0

            def settle() -> Iterator[pa.RecordBatch]:
                for lang, parts in by.items():
                    h, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([number[lang]] * len(h), pa.int32()), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])
                by.clear()

            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(np.unique(grams(text)))
                held += len(by[lang][-1])
                if held > HELD_GRAMS:
                    yield from settle()
                    held = 0
            yield from settle()

    counted = sample.mapInArrow(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    numbers = F.create_map(*[F.lit(x) for lang, k in number.items() for x in (lang, k)])
    sampled = sample.groupBy("lang").agg(F.count("*").alias("docs")).select(F.element_at(numbers, F.col("lang")).alias("l"), "docs")
    frequent = counted.join(F.broadcast(sampled), F.col("lang") == F.col("l")).filter(F.col("n") >= F.greatest(F.lit(2), F.col("docs") * min_share))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in places(h, bits):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at)], ["lang", "slot"])

    bitmap = frequent.select("lang", "gram").mapInArrow(slots, "lang int, slot long")
    filled = bitmap.groupBy("slot", F.expr("lang div 8").cast("int").alias("plane")).agg(F.bit_or(F.expr("shiftleft(1, lang % 8)")).alias("mask"))
    got = filled.toArrow()  # at most one row per slot and plane: bounded by the filter's size
    planes[got["plane"].to_numpy(), got["slot"].to_numpy()] = got["mask"].to_numpy()
    fill = np.array([np.mean(planes[k // 8] >> (k % 8) & 1) for k in range(len(languages))])
    return LanguageModel(languages, planes, fill**HASHES, bits)


def classify(docs: DataFrame, model: LanguageModel, text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """docs with lang_pred, score and coverage, from the text alone."""
    spark = session(docs)
    ready(spark)
    shared = spark.sparkContext.broadcast(model)
    own = ["lang_pred", "score", "coverage"]
    kept = [c for c in docs.columns if c.lower() not in own and not (drop_text and c == text_col)]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").alias(fresh(docs, "__text")))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            got = [found.predict(t) for t in batch.column(len(kept)).to_pylist()]
            columns = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], [*kept, *own])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "lang_pred string, score double, coverage double"])
    return rows.mapInArrow(judge, schema)
