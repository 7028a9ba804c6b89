"""SentencePiece encoding and decoding with a max-plus parallel scan.

A path of pieces over a text is the model's own encoding exactly if every two neighbouring pieces are: encoding their joined text gives
the two back. (Each piece's merges then finish before anything could merge across a boundary.) So encoding is a path problem with the
last piece as state, and paths combine in the max-plus semiring: an impossible step is minus infinity, a piece weighs -1.

A giant document is split into chunks at fixed places. A chunk yields the transfer matrix from the states at its left boundary (a piece
that covers it, and how far it reaches over) to those at its right one. Matrices combine associatively, in a tree over a document; that
fixes the state at every boundary, and each chunk is then backtraced on its own. Inside a chunk, places where no piece of the vocabulary can span
the two characters have one state, so the matrix is the product of a left part, a scalar and a right part; stretches between such
places are remembered, and their ids are kept with the matrix, as no state changes them. Text without such places runs through the full matrix.

Results equal the library's for BPE models with an identity normalizer and a dummy prefix, byte fallback included. Decoding is exact but
for the space mark itself (U+2581), which decodes to a space.

Defined results: null and empty texts have no tokens and decode to the empty text; repeated rows each get theirs (a row number is
attached before giant documents are split); null ids stay null. Empty tables give no rows. Very long texts are chunked, never cut.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ready, rows_of, session
from ledgerloom.runtime import forget, later, written

MARK = "▁"
#: Characters of a chunk; longer documents are giant.
CHUNK = 16384
#: Chunks, or blocks of them, whose matrices one task combines.
FAN = 64
#: Workers of several stages stay alive side by side in an executor, so what each remembers is small. Units and words have two generations of
#: so many: a full one becomes the old one, from which what is asked for again comes back.
MEMO_UNITS, MEMO_WORDS, MEMO_PAIRS = 150_000, 100_000, 500_000
_START, _CUT = -1, -2
_NEVER = 1 << 62


class Pieces:
    """The vocabulary of a BPE model and what decides whether two pieces may stand side by side."""

    def __init__(self, path: str):
        import sentencepiece

        self.path = path
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte_id = [0] * 256
        self.id: dict[str, int] = {}
        self.text: list[str] = [""] * n
        self.rank: list[float] = [0.0] * n
        for k in range(n):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                value = int(piece[3:5], 16)
                self.byte_id[value] = k
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                self.id[piece], self.text[k], self.rank[k] = k, piece, -model.get_score(k)
        self.longest = max(map(len, self.id), default=1)
        self.spans = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        self.marks_lead = not any(a != MARK and b == MARK for a, b in self.spans)
        self.left, self.right = self._chains()
        #: Usable pieces by their characters: a node is its piece, or -1, and the nodes that follow.
        self.tree: tuple[int, dict] = (-1, {})
        for p, k in sorted(self.id.items(), key=lambda x: -len(x[0])):
            if k in self.left:
                self._plant(p, k)
        self.pairs: dict[int, bool] = {}
        self.units: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old_units: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def _plant(self, piece: str, k: int) -> None:
        """Longer pieces come first, so the nodes of a piece's own beginnings are there when it ends on one of them."""
        after = self.tree[1]
        for c in piece[:-1]:
            after = after.setdefault(c, (-1, {}))[1]
        after[piece[-1]] = (k, after.get(piece[-1], (-1, {}))[1])

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """BPE by definition: the best-ranked, then leftmost pair merges until none is left. Symbols, and the parts of the last merge."""
        symbols, last = list(text), None
        while True:
            best = None
            for k in range(len(symbols) - 1):
                found = self.id.get(symbols[k] + symbols[k + 1])
                if found is not None and (best is None or self.rank[found] < best[0]):
                    best = (self.rank[found], k)
            if best is None:
                return symbols, last
            k = best[1]
            last = (symbols[k], symbols[k + 1])
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]

    def _chains(self) -> tuple[dict, dict]:
        """For each usable piece, its outermost parts on the left and on the right as it forms: (text, made at, absorbed at)."""
        parts: dict[str, tuple[str, str] | None] = {}
        for piece in sorted(self.id, key=len):
            symbols, last = self.merge(piece)
            if len(symbols) == 1:
                parts[piece] = last
        left, right = {}, {}
        for piece in parts:
            for out, side in ((left, 0), (right, 1)):
                chain, now, until = [], piece, _NEVER
                while now is not None:
                    inner = parts.get(now)
                    made = self.rank[self.id[now]] if inner else -1
                    chain.append((now, made, until))
                    now, until = (inner[side], made) if inner else (None, made)
                out[self.id[piece]] = chain
        return left, right

    def fit(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a: nothing merges across their boundary before both are whole."""
        if a < 0 or b < 0:
            return True
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > MEMO_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._fit(a, b)
        return known

    def _fit(self, a: int, b: int) -> bool:
        ta, tb = self.text[a], self.text[b]
        if ta[-1] + tb[0] not in self.spans:
            return True
        if ta[-1] == tb[0] == MARK:  # runs of marks tie in rank: by definition
            return self.merge(ta + tb)[0] == [ta, tb]
        for x, made_x, until_x in self.right[a]:
            for y, made_y, until_y in self.left[b]:
                if made_x < until_y and made_y < until_x:
                    found = self.id.get(x + y)
                    if found is not None:
                        rank = self.rank[found]
                        # of equal ranks the left one goes first: a's own merge before, b's own merge after the boundary's
                        if rank < until_x and rank <= until_y:
                            return False
        return True

    def ending(self, text: str, p: int, least: int) -> Iterator[tuple[int, int]]:
        """(start, piece) of the pieces that end at p and start at least or later, longest first; an unknown character is piece -3."""
        for q in range(max(least, p - self.longest), p):
            k = self.id.get(text[q:p])
            if k is not None and k in self.left:
                yield q, k
            elif q == p - 1 and k is None:
                yield q, -3

    def ids(self, text: str, start: int, end: int, piece: int) -> list[int]:
        return [piece] if piece >= 0 else [self.byte_id[v] for v in text[start:end].encode()]

    def walk(self, text: str, start: int, last: int, end: int) -> dict[int, tuple[int, int, int]]:
        """From a state at start: for every place up to end, the one (piece, its start, tokens so far) that may end there.

        Pieces are tried from each place that a path reaches, in order, for as long as some piece begins with the characters.
        """
        table = {start: (last, start, 0)}
        top, longest, known, pairs = self.tree[1], self.longest, self.id, self.pairs
        for q in range(start, end):
            before = table.get(q)
            if before is None:
                continue
            piece, _, n = before
            after, p = top, q
            for c in text[q : min(end, q + longest)]:
                node = after.get(c)
                if node is None:
                    break
                k, after = node
                p += 1
                if k >= 0 and p not in table:
                    fits = True if piece < 0 else pairs.get(piece << 20 | k)
                    if fits is None:
                        fits = self.fit(piece, k)
                    if fits:
                        table[p] = (k, q, n + 1)
            if q + 1 not in table and text[q] not in known:
                table[q + 1] = (-3, q, n + len(text[q].encode()))
        return table

    def trace(self, text: str, table: dict, start: int, p: int) -> list[int]:
        """The token ids of a table's path from start to p."""
        out = []
        while p > start:
            k, q, _ = table[p]
            out.append(self.ids(text, q, p, k))
            p = q
        return [x for ids in reversed(out) for x in ids]

    def unit(self, text: str) -> bytes:
        """Ids (uint32) of a text that begins and ends where no piece can span, remembered."""
        found = self.units.get(text)
        if found is None:
            if len(self.units) >= MEMO_UNITS:
                self.old_units, self.units = self.units, {}
            found = self.old_units.get(text)
            if found is None:
                whole = self.id.get(text)
                if whole in self.left:  # a path of one piece
                    ids = [whole]
                else:
                    ids = self.trace(text, self.walk(text, 0, _START, len(text)), 0, len(text))
                found = struct.pack(f"<{len(ids)}I", *ids)
            self.units[text] = found
        return found

    def cut(self, text: str, places: range) -> int:
        """The first of these inner places of a text where no piece can span the characters on both sides; -1 without one."""
        spans = self.spans
        return next((p for p in places if text[p - 1 : p + 1] not in spans), -1)

    def between_cuts(self, text: str) -> bytes:
        """Ids of a stretch between two cuts."""
        head, mark, rest = text.partition(MARK)
        if not self.marks_lead or not mark or MARK + MARK in text or text.endswith(MARK):
            return self._units(text)
        return (self._units(head) if head else b"") + self.words_after_marks(rest.split(MARK))

    def words_after_marks(self, words: list[str]) -> bytes:
        """Ids of words, none empty, each with a mark before it. Whole words are remembered too."""
        memo = self.words
        try:
            return b"".join(map(memo.__getitem__, words))
        except KeyError:
            pass
        if len(memo) >= MEMO_WORDS:
            self.old_words, self.words = memo, {}
            memo = self.words
        old = self.old_words.get
        for w in {*words}:
            if w not in memo:
                memo[w] = old(w) or self._units(MARK + w)
        return b"".join(map(memo.__getitem__, words))

    def _units(self, text: str) -> bytes:
        spans, known, out, a = self.spans, self.units.get, [], 0
        for p in [p for p, x in enumerate(map(add, text, text[1:]), 1) if x not in spans]:
            part = text[a:p]
            out.append(known(part) or self.unit(part))
            a = p
        out.append(self.unit(text[a:]))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """All ids of a whole text as little-endian uint32."""
        if not text:
            return b""
        if self.marks_lead and MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return self.words_after_marks(text.split(" "))
        return self.between_cuts(MARK + text.replace(" ", MARK))

    def decode(self, ids: np.ndarray) -> str:
        return decoder(self.path).decode(ids)

    # Chunks. A state at a boundary is (piece, overhang) as piece * 64 + overhang; _START begins a document; _CUT is any state at a cut.

    def states(self, text: str, at: int) -> list[int]:
        """The states at a boundary: all pieces of the text that cover or end at it."""
        if text[at - 1 : at + 1] not in self.spans and at < len(text):
            return [_CUT]
        out = []
        for p in range(at, min(len(text), at + self.longest - 1) + 1):
            for q, k in self.ending(text, p, 0):
                if q < at and (k >= 0 or p == at):
                    out.append((k + 8) * 64 + p - at)
        return out

    def transfer(self, text: str, a: int, b: int) -> tuple[dict[int, dict[int, int]], int, int, bytes]:
        """The transfer matrix of text[a:b] in its context: state at a -> state at b -> minus the tokens between (absent: minus infinity);
        its first and last inner cut, and the ids between them, which no state changes. Without a cut the places are -1."""
        entries = [_START] if a == 0 else self.states(text, a)
        first = self.cut(text, range(a + 1, b))
        ends = self.states(text, b) if b < len(text) else None

        def out(table: dict) -> dict[int, int]:
            if ends is None or ends == [_CUT]:
                return {_CUT: -table[b][2]} if b in table else {}
            found = {}
            for p in range(b, min(len(text), b + self.longest - 1) + 1):
                if p in table and table[p][1] < b:
                    found[(table[p][0] + 8) * 64 + p - b] = -table[p][2]
            return found

        reach = min(len(text), b + self.longest - 1)
        if first < 0:
            return {s: out(self.walk(text, *self._from(s, a), reach)) for s in entries}, -1, -1, b""
        last = self.cut(text, range(b - 1, a, -1))
        right = out(self.walk(text, last, _CUT, reach))
        middle = self.between_cuts(text[first:last])
        matrix = {}
        for s in entries:
            start, piece = self._from(s, a)
            table = self.walk(text, start, piece, first) if start <= first else {}
            if first in table:
                matrix[s] = {e: w - len(middle) // 4 - table[first][2] for e, w in right.items()}
        return matrix, first, last, middle

    def _from(self, state: int, a: int) -> tuple[int, int]:
        """Where a state's piece ends, and the piece."""
        return (a, state) if state in (_START, _CUT) else (a + state % 64, state // 64 - 8)

    def backtrace(self, head: str, tail: str, a: int, b: int, first: int, middle: bytes, entry: int, exit_: int) -> bytes:
        """The ids of the pieces that start in a chunk, given the states at both boundaries. head is the text up to the first inner cut,
        in which the chunk begins at a; tail the text from the last one, in which it ends at b. Without a cut head is all the text."""
        start, piece = self._from(entry, a)
        end = b if exit_ == _CUT else b + exit_ % 64
        if first < 0:
            return np.array(self.trace(head, self.walk(head, start, piece, end), start, end), "<u4").tobytes()
        before = self.trace(head, self.walk(head, start, piece, first), start, first)
        after = self.trace(tail, self.walk(tail, 0, _CUT, end), 0, end)
        return np.array(before, "<u4").tobytes() + middle + np.array(after, "<u4").tobytes()


class Decoder:
    """The bytes of every piece, and nothing else of a model: a decoding worker runs beside an encoding one."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of = [b""] * model.get_piece_size()
        for k in range(len(self.bytes_of)):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.bytes_of[k] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                self.bytes_of[k] = piece.replace(MARK, " ").encode()

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def combine(first: dict[int, dict[int, int]], then: dict[int, dict[int, int]]) -> dict[int, dict[int, int]]:
    """The max-plus product of two transfer matrices; associative."""
    out: dict[int, dict[int, int]] = {}
    for s, row in first.items():
        best: dict[int, int] = {}
        for mid, w in row.items():
            for e, v in then.get(mid, {}).items():
                if w + v > best.get(e, -_NEVER):
                    best[e] = w + v
        if best:
            out[s] = best
    return out


def boundary_states(matrices: list[dict[int, dict[int, int]]], entry: int = _START, exit_: int = _CUT) -> list[int]:
    """The states at all boundaries of neighbouring chunks (one more than chunks) between two known ones, by a forward scan of products
    and a backward choice."""
    prefix = [{entry: {entry: 0}}]
    for m in matrices:
        prefix.append(combine(prefix[-1], m))
    states = [exit_]
    for k in range(len(matrices) - 1, -1, -1):
        row = prefix[k][entry]
        states.append(max((s for s in row if states[-1] in matrices[k].get(s, {})), key=lambda s: row[s] + matrices[k][s][states[-1]]))
    return states[::-1]


def flat(matrix: dict[int, dict[int, int]]) -> list[int]:
    """A matrix as integers: per row its state, its entries' number, and the entries."""
    return [x for s, row in matrix.items() for x in (s, len(row), *(y for entry in row.items() for y in entry))]


def unflat(data: list[int]) -> dict[int, dict[int, int]]:
    out, at = {}, 0
    while at < len(data):
        s, n = data[at : at + 2]
        out[s] = dict(zip(data[at + 2 : at + 2 + 2 * n : 2], data[at + 3 : at + 2 + 2 * n : 2], strict=True))
        at += 2 + 2 * n
    return out


def chunk_places(n: int, chunk: int = CHUNK) -> list[int]:
    """Boundaries of a normalized text of n characters; the last chunk is never shorter than half of one."""
    k = max(1, (2 * n) // (2 * chunk)) if n % chunk >= chunk // 2 or n < chunk else n // chunk
    return [*range(0, k * chunk, chunk), n]


_LOADED: dict[str, Pieces] = {}
_DECODERS: dict[str, Decoder] = {}


def decoder(path: str) -> Decoder:
    if path not in _DECODERS:
        _DECODERS[path] = Decoder(path)
    return _DECODERS[path]


def loaded(path: str) -> Pieces:
    """One vocabulary per worker process."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def _scan(matrices: DataFrame, fan: int) -> DataFrame:
    """row, k, entry, exit: the states at both boundaries of every chunk of (row, k, matrix), as a written table.

    Up the tree, the products of fan neighbours are formed until each document is one block; down it, the states at a block's boundaries
    give those between its children. A task holds fan matrices of a block at a time, however long the document.
    """
    spark = session(matrices)
    levels = [matrices]

    def product(key, table):
        table = table.sort_by("k")
        out = unflat(table["matrix"][0].as_py())
        for m in table["matrix"].to_pylist()[1:]:
            out = combine(out, unflat(m))
        return pa.table({"row": table["row"].slice(0, 1), "k": pa.array([key[1].as_py()], pa.int64()), "matrix": pa.array([flat(out)], pa.list_(pa.int64()))})

    while levels[-1].agg(F.max("k")).first()[0]:
        blocks = levels[-1].groupBy("row", F.expr(f"k div {fan}").alias("block")).applyInArrow(product, "row long, k long, matrix array<long>")
        levels.append(written(spark, blocks, "products"))

    def between(key, table):
        table = table.sort_by("k")
        states = boundary_states([unflat(m) for m in table["matrix"].to_pylist()], table["entry"][0].as_py(), table["exit"][0].as_py())
        return pa.table({"row": table["row"], "k": table["k"], "entry": pa.array(states[:-1], pa.int64()), "exit": pa.array(states[1:], pa.int64())})

    states = written(spark, levels[-1].select("row", "k", F.lit(_START).cast("long").alias("entry"), F.lit(_CUT).cast("long").alias("exit")), "states")
    for level in levels[-2::-1]:
        blocks = level.withColumn("block", F.expr(f"k div {fan}")).join(states.withColumnRenamed("k", "block"), ["row", "block"])
        before, states = states, written(spark, blocks.groupBy("row", "block").applyInArrow(between, "row long, k long, entry long, exit long"), "states")
        forget(spark, before)
    forget(spark, *levels[1:])
    return states


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """doc_id and packed: all ids of the whole text as little-endian uint32, end to end."""
    spark = session(docs)
    ready(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for batch in batches:
            packed = [pieces.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["doc_id", "packed"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for batch in batches:
            for row, doc_id, text in zip(*rows_of(batch, "row", "doc_id", "text"), strict=True):
                text = MARK + text.replace(" ", MARK)
                at, side = chunk_places(len(text), chunk), 2 * pieces.longest
                for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                    lo, hi = max(0, a - side), min(len(text), b + side)
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((row, pa.int64()), (doc_id, pa.int64()), (k, pa.int64()), (text[lo:hi], pa.string()), (a - lo, pa.int64()), (b - lo, pa.int64()))], ["row", "doc_id", "k", "part", "a", "b"])

    length = F.length("text")
    giant = rows.filter(length >= chunk).withColumn("row", F.monotonically_increasing_id())
    chunks = written(spark, giant.mapInArrow(split, "row long, doc_id long, k long, part string, a long, b long"), "chunks")

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for batch in batches:
            found = []
            for part, a, b in zip(*rows_of(batch, "part", "a", "b"), strict=True):
                m, first, last, middle = pieces.transfer(part, a, b)
                head, tail = (part, "") if first < 0 else (part[:first], part[last:])
                found.append((flat(m), head, tail, a, b if first < 0 else b - last, first, middle))
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.list_(pa.int64()), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("k"), *columns], ["row", "doc_id", "k", "matrix", "head", "tail", "a", "b", "first", "middle"])

    transfers = written(spark, chunks.mapInArrow(matrix, "row long, doc_id long, k long, matrix array<long>, head string, tail string, a long, b long, first long, middle binary"), "transfers")
    forget(spark, chunks)
    states = _scan(transfers.select("row", "k", "matrix"), fan)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for batch in batches:
            packed = [pieces.backtrace(*x) for x in zip(*rows_of(batch, "head", "tail", "a", "b", "first", "middle", "entry", "exit"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("k"), pa.array(packed, pa.binary())], ["row", "doc_id", "k", "packed"])

    def joined(key, table):
        table = table.sort_by("k")
        return pa.table({"doc_id": table["doc_id"].slice(0, 1), "packed": pa.array([b"".join(table["packed"].to_pylist())], pa.binary())})

    later(spark, transfers, states)
    # a piece that ends past the boundary belongs to the chunk where it starts
    traced = transfers.drop("matrix").join(states, ["row", "k"]).mapInArrow(back, "row long, doc_id long, k long, packed binary")
    whole = traced.groupBy("row").applyInArrow(joined, "doc_id long, packed binary")
    return rows.filter(length < chunk).mapInArrow(small, "doc_id long, packed binary").unionByName(whole)


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, packed and the text that the ids stand for."""
    ready(session(encoded))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = decoder(model)
        for batch in batches:
            texts = [pieces.decode(np.frombuffer(x, "<u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "packed", "text"])

    return encoded.select("doc_id", "packed").mapInArrow(run, "doc_id long, packed binary, text string")
