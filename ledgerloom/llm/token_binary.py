"""Token-ID / binary output: flat unsigned-integer files with 64-bit document offsets.

Layout of a token store (one folder):

* ``tokens-*.bin``  ids of one range partition, little-endian, uint16 where the vocabulary fits and uint32 else;
* ``tokens-*.off``  int64 offsets, one more than documents, local to the file;
* ``tokens-*.doc``  int64 document ids (the smallest int64 stands for a null id).

A manifest row per file holds its place in document order (partition and turn) and its base: the ids of all files before it, a prefix
sum over the files' totals. A partition's files roll at FILE_BYTES. Documents are range-partitioned by id and sorted inside a partition, so the files in manifest order hold the
corpus in ascending doc_id order. File names are unique to a task attempt and the manifest lists only files of attempts that
Spark committed, so lost executors, retries and speculation leave nothing but unlisted files.

Defined results: null text is the empty document (its end id alone); null doc_id sorts first; rows with equal ids are kept, by
text; an empty table is a store without files. Other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import open_fs, ready, rows_of, session
from ledgerloom.runtime import forget, scratch_path, written

NULL_ID = -(1 << 63)
#: Words and letter runs whose ids a worker remembers, and the words of one text given to the library. They bound memory only.
MEMO_WORDS, MEMO_LETTERS, CALL_WORDS = 500_000, 700_000, 100
#: Bytes of ids after which a file rolls, and documents whose offsets a task holds.
FILE_BYTES, FLUSH_DOCS = 1 << 30, 100_000
#: What ends the last token of a word in vocabularies with word ends.
SUFFIX = "</w>"
#: Lower-case letters of the first 256 code points, and ASCII punctuation after them: nothing that a normalizer could compose.
_LATIN = re.compile(r"([a-zß-öø-ÿ]+)([!-/:-@\[-^`{-~]*)")
#: Python's split() also splits at these, which the tokenizer's pattern takes as ordinary characters.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: The characters of Unicode's White_Space property.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


class WordEncoder:
    """Ids of texts for a tokenizer whose tokens never cross white space, from memos of words.

    White space only separates words in such a tokenizer, so a text's ids are its words' ids in order. The library encodes each
    distinct word once while it stays in a memo. Where the tokenizer folds case and marks word ends (its tokens end in SUFFIX), a word
    of Latin letters with ASCII punctuation after it shares its letters' ids with all other spellings, and new letters are encoded many
    in one call. Every other word, any with a combining mark among them, is encoded by the library as it is.
    """

    def __init__(self, path: str, dtype: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype(dtype or ("<u2" if size <= 1 << 16 else "<u4"))
        self.ends = np.zeros(size, bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.ends[k] = token.endswith(SUFFIX)
        self.parts = self.ends.any() and self._ids("Ab,") == self._ids("ab") + self._ids(",")
        self.memo: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def words(self, text: str) -> list[str]:
        if self.parts and "<|" not in text:  # folding case first changes no ids here, and is the same in all libraries
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return text.split() if not any(c in text for c in _SEPARATORS) else [w for w in _SPACE.split(text) if w]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of the dtype."""
        lists = [self.words(t) for t in texts]
        if len(self.memo) > MEMO_WORDS:
            self.memo = {}
        if len(self.letters) > MEMO_LETTERS:
            self.letters = {}
        self.learn(set().union(*lists).difference(self.memo))
        get = self.memo.__getitem__
        return [b"".join(map(get, words)) for words in lists]

    def learn(self, missing: set[str]) -> None:
        memo, letters, match = self.memo, self.letters, _LATIN.fullmatch
        split, whole = [], missing
        if self.parts:
            split = [m for m in map(match, missing) if m]
            whole = missing.difference([m[0] for m in split])
        new = list({a for m in split if (a := m[1]) not in letters})
        if new:
            texts = [" ".join(new[k : k + CALL_WORDS]) for k in range(0, len(new), CALL_WORDS)]
            ids = np.concatenate([np.array(x.ids, self.dtype) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize
            if len(cuts) != len(new):
                raise ValueError("the tokenizer does not mark word ends")
            data, at = ids.tobytes(), 0
            for x, cut in zip(new, cuts.tolist(), strict=True):
                letters[x] = data[at:cut]
                at = cut
        rest = [*whole, *{b for m in split if (b := m[2]) and b not in memo}]
        if rest:
            for word, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
                memo[word] = np.array(found.ids, self.dtype).tobytes()
        for m in split:
            w, a, b = m[0], m[1], m[2]
            memo[w] = letters[a] + memo[b] if b else letters[a]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and vocabulary."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


@dataclass(frozen=True)
class TokenStore:
    """A written store: its folder and its manifest (part, turn, file, width, n_docs, n_ids, base)."""

    folder: str
    manifest: DataFrame


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> TokenStore:
    """Encodes every whole text, appends end_id, and writes the store, in files that roll once they reach file_bytes."""
    spark = session(docs)
    ready(spark)
    folder = folder or scratch_path(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        end = np.array([end_id], enc.dtype).tobytes()
        part, streams, held, n_docs, n_ids, name, turn = TaskContext.get().partitionId(), [], [], 0, 0, "", 0

        def flush() -> None:
            streams[1].write(np.array([x for _, x in held], "<i8").tobytes())
            streams[2].write(np.array([x for x, _ in held], "<i8").tobytes())
            held.clear()

        def close() -> pa.RecordBatch:
            flush()
            for s in streams:
                s.close()
            streams.clear()
            row = {"part": part, "turn": turn, "file": name, "width": enc.dtype.itemsize, "n_docs": n_docs, "n_ids": n_ids}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([(k, pa.string() if k == "file" else pa.int64()) for k in row]))

        for batch in batches:
            ids_of, texts = rows_of(batch, "id", "text")
            for doc_id, data in zip(ids_of, enc.encode(texts), strict=True):
                if not streams:
                    name, n_docs, n_ids = f"{folder}/tokens-{part:08d}-{uuid.uuid4().hex}", 0, 0
                    fs, path = open_fs(name)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    streams.extend(fs.open_output_stream(f"{path}.{x}", buffer_size=1 << 20) for x in ("bin", "off", "doc"))
                    streams[1].write(np.zeros(1, "<i8").tobytes())
                streams[0].write(data)
                streams[0].write(end)
                n_docs, n_ids = n_docs + 1, n_ids + len(data) // enc.dtype.itemsize + 1
                held.append((NULL_ID if doc_id is None else doc_id, n_ids))
                if len(held) >= FLUSH_DOCS:
                    flush()
                if n_ids * enc.dtype.itemsize >= file_bytes:
                    yield close()
                    turn += 1
        if streams:
            yield close()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    columns = "part long, turn long, file string, width long, n_docs long, n_ids long"
    files = written(spark, ordered.mapInArrow(write, columns), "token-files")
    total, out = 0, []
    for r in files.orderBy("part", "turn").collect():  # a row per file, not per document
        out.append((*r, total))
        total += r["n_ids"]
    forget(spark, files)
    return TokenStore(folder, spark.createDataFrame(out, f"{columns}, base long"))


def _mapped(name: str, dtype: str) -> np.ndarray:
    """An array of a file: memory-mapped on a local or mounted file system, read in one request elsewhere."""
    import pyarrow.fs as pafs

    fs, path = open_fs(name)
    if isinstance(fs, pafs.LocalFileSystem):
        import os

        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def open_file(file: str, width: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, offset in the file, ids) of every document of one file of a store."""
    ids, offsets, docs = _mapped(f"{file}.bin", f"<u{width}"), _mapped(f"{file}.off", "<i8"), _mapped(f"{file}.doc", "<i8")
    for k, doc in enumerate(docs.tolist()):
        a, b = int(offsets[k]), int(offsets[k + 1])
        yield None if doc == NULL_ID else doc, a, ids[a:b]


def read_tokens(spark: SparkSession, store: TokenStore, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian uint32) of every document, from the files; with_ids adds ids."""
    ready(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list) -> pa.RecordBatch:
            names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
            types = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        for batch in batches:
            for file, width, base in zip(*rows_of(batch, "file", "width", "base"), strict=True):
                rows, held = [], 0
                for doc, at, ids in open_file(file, width):
                    rows.append((doc, base + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *[ids.tolist()] * with_ids))
                    held += len(ids) * with_ids + 1
                    if held > 1_000_000 or len(rows) >= 20_000:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    n = max(1, min(store.manifest.count(), spark.sparkContext.defaultParallelism * 4))
    spread = store.manifest.repartition(n)
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
