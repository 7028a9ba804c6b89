"""Secret scans: pattern rules and a battery of randomness tests.

Pattern rules find assignments, access keys and hex strings. The battery looks at every other run of 16 or more token characters with a
letter in it (digits alone are numbers). A run is parted at '=' that is not its final padding (NAME=value), and where no one encoding
holds a part, at '_' and '-' or at '/' and '+' (names and paths beside a value). It infers a part's encoding, the narrowest alphabet that
holds it (hex, letters of one case, base32, alphanumeric, base64), and asks of every part:

* Is it random in that encoding? Chi-squared uniformity over the alphabet, a runs test about the alphabet's middle and lag-1 serial
  correlation give three p-values; three times the smallest bounds their joint one, the battery's p. Below ALPHA the part is not random.
* Is it ordinary text? The likelihood ratio of the uniform source against a text source, times the battery's p, has a mean of at most one
  under the text source, so its inverse bounds the p-value of text (Markov's inequality): a part that the battery doubts needs so much
  more evidence against text. Benjamini-Hochberg at FDR over all parts of the document decides, weighted by length: a part's level is
  in proportion to its share of the document's tested characters (weights of mean one keep the rate), as short parts, of which there
  are many, are seldom secrets.

Defined results: null text is the empty text; no findings is an empty array. Very long texts are scanned whole. Spans are code points,
end exclusive. Repeated rows keep their own results; other columns stay, except that own result names replace clashing ones.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh, ready, session

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a maximal run of 18 or more: shorter ones fail and hide nothing
HEX = re.compile(r"[0-9a-f]{16,}")
LONG_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_PART = re.compile(r"[^=]{16,}")
#: What remains between name separators (base64) and between path separators (base64url) of a part that no one encoding holds.
_INNER = (re.compile(r"[^_-]{16,}"), re.compile(r"[^/+]{16,}"))
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_LETTER = re.compile(r"[A-Za-z]")

#: Level at which the battery rejects randomness, and the false-discovery rate of a document's findings.
ALPHA, FDR = 0.001, 0.0001

#: Encodings from narrow to wide, each with its alphabet in value order.
ENCODINGS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "UPPER": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "UPPER36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "alnum": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Letters by frequency in English text, per ten thousand.
LETTER_FREQUENCY = {"e": 1202, "t": 910, "a": 812, "o": 768, "i": 731, "n": 695, "s": 628, "r": 602, "h": 592, "d": 432, "l": 398, "u": 288, "c": 271, "m": 261, "f": 230, "y": 211, "w": 209, "g": 203, "p": 182, "b": 149, "v": 111, "k": 69, "x": 17, "q": 11, "j": 10, "z": 7}


def _class(c: str) -> str:
    return "d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s"


@lru_cache(1)
def _text_source() -> tuple[dict[str, float], dict[tuple[str, str], float]]:
    """The text source: log-probability of a character within its class, and of a class after a class (classes come in runs)."""
    within = {c: math.log(n / 10000) for c, n in LETTER_FREQUENCY.items()}
    within |= {c.upper(): p for c, p in within.items()} | {c: math.log(0.1) for c in "0123456789"} | {c: math.log(0.2) for c in "+/_-="}
    stay = {"d": 0.70, "u": 0.45, "l": 0.90, "s": 0.10}
    leave = {"d": {"u": 0.2, "l": 0.4, "s": 0.4}, "u": {"d": 0.1, "l": 0.8, "s": 0.1}, "l": {"d": 0.3, "u": 0.3, "s": 0.4}, "s": {"d": 0.35, "u": 0.2, "l": 0.45}}
    step = {(a, b): math.log(stay[a] if a == b else (1 - stay[a]) * leave[a][b]) for a in stay for b in stay}
    return within, step


def infer_encoding(run: str) -> str | None:
    """The narrowest encoding that holds all characters of a run, padding aside."""
    used = set(run)
    return next((name for name, alphabet in ENCODINGS.items() if used <= set(alphabet)), None)


def _chi2_tail(x: float, df: int) -> float:
    """P(chi-squared with df degrees of freedom > x), by the Wilson-Hilferty cube-root normal approximation."""
    return 0.5 * math.erfc((((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))) / math.sqrt(2))


def battery(values: list[int], size: int) -> tuple[float, float, float]:
    """p-values under randomness: chi-squared uniformity (cells of 4 or more expected), runs about the middle, lag-1 correlation."""
    n = len(values)
    cells = max(2, min(size, n // 4))
    counts = [0] * cells
    width = [0] * cells
    for v in range(size):
        width[v * cells // size] += 1
    for v in values:
        counts[v * cells // size] += 1
    chi = sum((c - n * w / size) ** 2 / (n * w / size) for c, w in zip(counts, width, strict=True))
    high = [v * 2 >= size for v in values]
    n1 = sum(high)
    n0 = n - n1
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    if n0 and n1:
        mean = 1 + 2 * n0 * n1 / n
        var = max(1e-9, (mean - 1) * (mean - 2) / (n - 1))
        p_runs = math.erfc(abs(runs - mean) / math.sqrt(2 * var))
    else:
        p_runs = 0.0
    mu = sum(values) / n
    spread = sum((v - mu) ** 2 for v in values)
    if spread:
        r = sum((a - mu) * (b - mu) for a, b in zip(values, values[1:], strict=False)) / spread
        p_serial = math.erfc(abs(r + 1 / n) * math.sqrt(n / 2))
    else:
        p_serial = 0.0
    return _chi2_tail(chi, cells - 1), p_runs, p_serial


def text_p_value(run: str, size: int) -> float:
    """A bound on the chance that the text source makes a run at least this favourable to the uniform source over size symbols.

    A run without lower-case letters is held against text in capitals.
    """
    within, step = _text_source()
    if run.upper() == run:
        run = run.lower()
    ratio = 0.0
    before = ""
    for c in run:
        now = _class(c)
        ratio += -math.log(size) - within[c] - (step[before, now] if before else math.log(0.25))
        before = now
    return min(1.0, math.exp(-ratio))


def parts(m: re.Match) -> Iterator[tuple[int, int, str]]:
    """Start, end and characters of the parts of a run, each in one encoding; final padding is in the span but not in the characters."""
    core = m[0].rstrip("=")
    for part in _PART.finditer(core):
        if infer_encoding(part[0]) is not None:
            inner = [(part.start(), part[0])]
        else:
            inner = [(part.start() + x.start(), x[0]) for by in _INNER for x in by.finditer(part[0])]
        for at, run in inner:
            end = at + len(run)
            yield m.start() + at, m.end() if end == len(core) else m.start() + end, run


def decide(tested: list[tuple[float, float, int]]) -> list[bool]:
    """Which parts are discoveries, of (text's p-value bound, the battery's p, length): weighted Benjamini-Hochberg at FDR."""
    total = sum(n for _, _, n in tested)
    # the battery's p enters the statistic, the length its level
    p = [min(1.0, text / max(battery_p, 1e-300)) * total / (n * len(tested)) for text, battery_p, n in tested]
    order = sorted(range(len(p)), key=p.__getitem__)
    last = max((k for k, i in enumerate(order, 1) if p[i] <= FDR * k / len(p)), default=0)
    found = {i for i in order[:last] if tested[i][1] >= ALPHA}
    return [i in found for i in range(len(p))]


def random_runs(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs outside the taken spans that pass the battery and, together, the document's false-discovery control."""
    spans, tested = [], []
    for a, b, run in (x for m in LONG_RUN.finditer(text) for x in parts(m)):
        if not _LETTER.search(run) or any(x < b and a < y for x, y in taken):
            continue
        alphabet = ENCODINGS[infer_encoding(run)]
        p = text_p_value(run, len(alphabet))
        # parts that are likely text count as tests, but need no battery: dividing by a p cannot make them discoveries
        joint = min(1.0, 3 * min(battery([alphabet.index(c) for c in run], len(alphabet)))) if p <= FDR else 1.0
        spans.append((a, b))
        tested.append((p, joint, len(run)))
    found: list[tuple[int, int]] = []
    for a, b in sorted(x for x, yes in zip(spans, decide(tested), strict=True) if yes):
        if found and a < found[-1][1]:  # two partings of one run
            found[-1] = found[-1][0], max(b, found[-1][1])
        else:
            found.append((a, b))
    return found


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all findings by start, then kind in the order of KINDS."""
    long_words = [w for w in text.split() if len(w) >= 16]
    found: list[tuple[int, int, int]] = []
    low = text.encode().lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if long_words:
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        joined = "\n".join(long_words)
        if HEX.search(joined):
            found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        if LONG_RUN.search(joined):
            found += [(a, 3, b) for a, b in random_runs(text, [(a, b) for a, _, b in found])]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def redact(text: str, findings: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """text with every finding replaced; overlapping findings become one mark."""
    out, at = [], 0
    for _, a, b in sorted(findings, key=lambda x: x[1]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, text_col: str = "text", redacted: bool = False) -> DataFrame:
    """docs without the text column, with secrets (array of kind, start, end); redacted keeps the text with its findings replaced."""
    ready(session(docs))
    own = {"secrets", "redacted_text"}
    kept = [c for c in docs.columns if c != text_col and c.lower() not in own]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").alias(fresh(docs, "__text")))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(len(kept)).to_pylist()]
            found = [find_secrets(t) for t in texts]
            columns = [pa.array([[dict(zip(("kind", "start", "end"), f, strict=True)) for f in x] for x in found], span)]
            if redacted:
                columns.append(pa.array([redact(t, f) for t, f in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], [*kept, "secrets", *["redacted_text"] * redacted])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "secrets array<struct<kind:string,start:bigint,end:bigint>>", *["redacted_text string"] * redacted])
    return rows.mapInArrow(scan, schema)
