"""Near-duplicate documents by ProbMinHash.

A document is its five-word shingles weighted by how often they occur. Every shingle is a Poisson process whose rate is its weight: its
arrivals come at exponential distances and fall on random registers, and a register keeps the shingle that arrives first. A shingle
stops as soon as its time is past the latest register (early termination). Two signatures agree in a register with the probability
Jaccard similarity of the weighted sets, which is plain Jaccard where weights are equal.

Equal texts collapse by a 128-bit hash first. Signatures of distinct texts are banded; pairs that share a band are verified by the exact
probability Jaccard similarity of their weighted shingles (see components.link); the connected components are the groups. Recall of
banding at a similarity s is 1 - (1 - s^8)^48: 0.99985 at 0.8, over 0.99999 at 0.85; documents that share a passage but little else
(similarity 0.3) meet in one of 320 cases. No link between texts that share a band is lost (see components.link).

Texts are read twice and never shuffled. The second reading keeps the candidates alone, by a Bloom filter of bounded size (a row that
it lets through by mistake is dropped by the join).

Defined results: words are runs of other than ASCII white space, case kept; a text of one to four words is one shingle; texts without
words group with equal texts only; null text is a group of its own. class_id names a group (its smallest text hash; null for null text);
group_id is its smallest doc_id (null where all are), which two groups can share if ids repeat. Rows of equal doc_id and text are copies
of one another. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import components
from ledgerloom.llm.common import fresh, ready, rows_of, session
from ledgerloom.llm.components import first_met, fits, link, shared_buckets
from ledgerloom.llm.skew import lookup
from ledgerloom.runtime import forget, later, written

WORDS, SIMILARITY = 5, 0.8
ROWS, BANDS = 8, 48
REGISTERS = ROWS * BANDS
#: The second filing counts shingles by so many bits of their hashes.
SLOTS_LOG2 = 18
#: Bits of the candidates' Bloom filter: 16 a candidate up to the cap (16 MB), past which more rows pass but none are lost.
BLOOM_LEAST, BLOOM_CAP, BLOOM_HASHES = 16, 27, 3
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MEMO_WORDS = 300_000
#: Shingles whose arrivals run in step; it bounds memory only.
STEP_SHINGLES = 200_000


class _Memo(dict):
    """Hashes of words, made on demand."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_memo = _Memo()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of a text's shingles, and their counts."""
    words = text.encode().split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(_memo) > _MEMO_WORDS:
        _memo.clear()
    h = np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mix(out * _M1 + h[k : len(h) - n + 1 + k])
    return np.unique(out, return_counts=True)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """A row per weighted set (hashes, weights): the shingle that each register sees first. All sets' arrivals run in step."""
    times, kept = np.full(len(sets) * registers, np.inf), np.zeros(len(sets) * registers, np.uint64)
    h = np.concatenate([x for x, _ in sets]) if sets else np.empty(0, np.uint64)
    weight = np.concatenate([w for _, w in sets]).astype(np.float64) if sets else np.empty(0)
    of = np.repeat(np.arange(len(sets)), [len(x) for x, _ in sets])
    at, k = np.zeros(len(h)), 0
    while len(h):
        k += 1
        draw = _mix(h ^ _mix(np.array([k], np.uint64) * _M1))
        at = at - np.log((((draw >> np.uint64(12)).astype(np.float64)) + 0.5) / (1 << 52)) / weight
        place = of * registers + (_mix(draw + _M1) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(times, place, at)
        first = times[place] == at
        kept[place[first]] = h[first]
        on = at < times.reshape(-1, registers).max(1)[of]
        h, weight, of, at = h[on], weight[on], of[on], at[on]
    return kept.reshape(-1, registers)


def signature(h: np.ndarray, weight: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The signature of one weighted set."""
    return signatures([(h, weight)], registers)[0]


def band_keys(kept: np.ndarray, rows: int = ROWS) -> list[int]:
    """A signed 64-bit key per band of so many rows."""
    return [int.from_bytes(xxhash.xxh64_digest(kept[at : at + rows].tobytes(), at // rows), "little", signed=True) for at in range(0, len(kept), rows)]


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """The exact probability Jaccard similarity of two weighted sets (sorted distinct keys), in n log n."""
    if not len(a) or not len(b):
        return 0.0
    keys = np.union1d(a, b)
    p, q = np.zeros(len(keys)), np.zeros(len(keys))
    p[np.searchsorted(keys, a)] = wa
    q[np.searchsorted(keys, b)] = wb
    with np.errstate(divide="ignore"):
        ratio = np.where(p > 0, q / np.where(p > 0, p, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    p, q, ratio = p[order], q[order], ratio[order]
    upto, rest = np.cumsum(p), np.sum(q) - np.cumsum(q)
    last = np.searchsorted(ratio, ratio, side="right") - 1
    both = (p > 0) & (q > 0)
    return float(np.sum(1 / (upto[last][both] / p[both] + rest[last][both] / q[both])))


def pack(h: np.ndarray, counts: np.ndarray) -> bytes:
    """Weighted shingles as bytes: 40 bits of each hash, and the places and counts of those that repeat."""
    more = np.flatnonzero(counts > 1)
    low = (h >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    return np.array([len(h)], "<u4").tobytes() + low.tobytes() + more.astype("<u4").tobytes() + counts[more].astype("<u4").tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    h = np.zeros((n, 8), np.uint8)
    h[:, :5] = np.frombuffer(data, np.uint8, 5 * n, 4).reshape(n, 5)
    rest = np.frombuffer(data, "<u4", offset=4 + 5 * n)
    w = np.ones(n)
    w[rest[: len(rest) // 2]] = rest[len(rest) // 2 :]
    return h.view("<u8").ravel(), w


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40 - SLOTS_LOG2)).astype(np.int64)


def rarest_first(h: np.ndarray, weight: np.ndarray, often: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """A set's shingles from the rarest on, by counts of slots, without those that come when too little weight is left for the similarity
    and those of no other text; the share of weight left with each, their number, and the largest share of one shingle."""
    order = np.lexsort((h, often[_slots(h)]))
    h, p = h[order], weight[order] / weight.sum()
    left = np.cumsum(p[::-1])[::-1]
    use = (left >= similarity - 1e-6) & (often[_slots(h)] > 1)
    return h[use], left[use], np.arange(len(h), 0, -1)[use], float(p.max())


def preceding(h: np.ndarray) -> pa.ListArray:
    """For every place in h, the values just before it, components.BEFORE at most."""
    n = np.minimum(np.arange(len(h)), components.BEFORE)
    ends = np.cumsum(n)
    within = np.arange(n.sum()) - np.repeat(ends - n, n)
    values = h.view(np.int64)[np.repeat(np.arange(len(h)) - n, n) + within]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values))


def _bloom_places(keys: list[bytes], bits: int) -> np.ndarray:
    h = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
    step = _mix(h + _M1) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) >> np.uint64(64 - bits) for i in range(BLOOM_HASHES)]).astype(np.int64)


def _key(doc_id: int | None, digest: bytes) -> bytes:
    return digest + (b"" if doc_id is None else doc_id.to_bytes(8, "little", signed=True))


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, id (the text's 128-bit hash; null for null text) and bands (empty without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bands, group = [], [], []

            def settle() -> None:
                found = iter(signatures([x for x in group if len(x[0])]))
                bands.extend(band_keys(next(found)) if len(x[0]) else [] for x in group)
                group.clear()

            for text in batch.column(1).to_pylist():
                ids.append(None if text is None else xxhash.xxh3_128_digest(text.encode()))
                group.append(shingles(text or ""))
                if sum(len(x[0]) for x in group) > STEP_SHINGLES:
                    settle()
            settle()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "id", "bands"])

    return docs.mapInArrow(run, "doc_id long, id binary, bands array<long>")


def _candidate_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, packed shingles of the wanted (doc_id, id), by a Bloom filter and then the ids themselves."""
    spark = session(docs)
    bits = min(BLOOM_CAP, max(16, (BLOOM_LEAST * wanted.count()).bit_length()))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_bloom_places([_key(*x) for x in zip(*rows_of(batch, "doc_id", "id"), strict=True)], bits).ravel())], ["slot"])

    words = wanted.mapInArrow(slots, "slot long").groupBy(F.expr("slot div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("mask")).toArrow()  # at most 2^(bits - 6) rows
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(table)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = shared.value
        for batch in batches:
            texts = [(d, t) for d, t in zip(*rows_of(batch, "doc_id", "text"), strict=True) if t is not None]
            if not texts:
                continue
            digests = [xxhash.xxh3_128_digest(t.encode()) for _, t in texts]
            at = _bloom_places([_key(d, x) for (d, _), x in zip(texts, digests, strict=True)], bits)
            hit = np.all(filled[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1), axis=0)
            rows = [(digests[k], pack(*shingles(texts[k][1]))) for k in np.flatnonzero(hit).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["id", "packed"])

    return docs.mapInArrow(read, "id binary, packed binary")


def _labelled(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and id, doc_id (its smallest), n (rows) and label of every distinct text; texts of one group share a label."""
    spark = session(docs)
    ready(spark)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    signed = written(spark, sign(texts), "signatures")
    classes = written(spark, signed.filter("id IS NOT NULL").groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.any_value("bands").alias("bands")), "text-classes")
    later(spark, signed, classes)
    each = -(-BANDS // components.TURNS)
    members = shared_buckets(classes.select("id", *[F.slice("bands", 1 + at, each).alias(f"bands{at}") for at in range(0, BANDS, each)]))
    wanted = classes.join(members.select("id").distinct(), "id", "left_semi").select("doc_id", "id")
    sets = written(spark, _candidate_sets(texts, wanted).join(wanted.select("id"), "id", "left_semi").dropDuplicates(["id"]), "candidate-sets") if members.count() else None

    def verify(pairs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [probability_jaccard(*unpack(x), *unpack(y)) >= similarity - 1e-9 for x, y in zip(*rows_of(batch, "pa", "pb"), strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        left, right = (sets.select(F.col("id").alias(x), F.col("packed").alias(f"p{x}")) for x in "ab")
        return pairs.join(left, "a").join(right, "b").select("a", "b", "pa", "pb").mapInArrow(run, "a binary, b binary")

    def again(ids: DataFrame) -> tuple[DataFrame, Column]:
        """Texts by the rarest of their shingles, which all texts that are similar share; common ones of the texts asked for come last."""
        asked = written(spark, sets.join(ids, "id", "left_semi").select("id", "packed"), "again")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 << SLOTS_LOG2, np.int64)
            for batch in batches:
                for data in rows_of(batch, "packed")[0]:
                    total += np.bincount(_slots(unpack(data)[0]), minlength=len(total))
            slot = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], ["slot", "n"])

        counted = asked.select("packed").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most a row per slot
        table = np.zeros(1 << SLOTS_LOG2, np.int64)
        table[counted["slot"].to_numpy()] = counted["n"].to_numpy()
        shared = spark.sparkContext.broadcast(table)

        def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, data in zip(*rows_of(batch, "id", "packed"), strict=True):
                    h, left, n, top = rarest_first(*unpack(data), shared.value, similarity)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([i] * len(h), pa.binary()), pa.array(left), pa.array(n), pa.array(np.full(len(h), top)), preceding(h)], ["bucket", "id", "left", "n", "top", "before"])

        filed = written(spark, asked.mapInArrow(rarest, "bucket long, id binary, left double, n long, top double, before array<long>"), "filed")
        forget(spark, asked)
        return filed, fits("a", "b", similarity) & first_met("a", "b")

    if sets is None:
        return signed, classes.select("id", "doc_id", "n", F.col("id").alias("label"))
    labels = link(members, verify, [again])
    later(spark, labels)
    forget(spark, members, sets)
    return signed, classes.join(labels, "id", "left").select("id", "doc_id", "n", F.coalesce("label", "id").alias("label"))


def group_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, id (text hash), class_id, group_id, group_size, for every row."""
    signed, labelled = _labelled(docs, id_col, text_col, similarity)
    groups = labelled.groupBy("label").agg(F.min("doc_id").alias("group_id"), F.sum("n").alias("group_size"))
    found = labelled.select("id", "n", "label").join(groups, "label").select("id", "n", F.col("label").alias("class_id"), "group_id", "group_size")
    total = signed.count()
    out = lookup(signed.select("doc_id", "id"), found, "id", "n", total)
    return out.select("doc_id", "id", "class_id", F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group: its smallest doc_id (null only where all are), of its texts with that id one. Null texts stay."""
    _, labelled = _labelled(docs, id_col, text_col, similarity)
    key, number = fresh(docs, "__key"), fresh(docs, "__id")
    best = labelled.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")).alias("best"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_key(*x) for x in zip(*rows_of(batch, "doc_id", "id"), strict=True)], pa.binary())], [key])

    stay = best.select("best.doc_id", "best.id").mapInArrow(keys, f"`{key}` binary")
    names, at = docs.columns, docs.columns.index(text_col)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_key(i, xxhash.xxh3_128_digest(t.encode())) for i, t in zip(batch.column(batch.num_columns - 1).to_pylist(), batch.column(at).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.binary())], [*names, key])

    null_texts = docs.filter(F.col(f"`{text_col}`").isNull())
    texts = docs.filter(F.col(f"`{text_col}`").isNotNull()).withColumn(number, F.col(f"`{id_col}`").cast("long"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{key}` binary"])
    kept = texts.mapInArrow(keyed, schema).join(stay, key, "left_semi").dropDuplicates([key])  # equal rows combine before they shuffle again
    return kept.drop(key).unionByName(null_texts)
