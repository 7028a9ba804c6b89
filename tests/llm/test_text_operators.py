"""Language ID, quality, secrets, tokens and pieces: edge cases, brute force and round trips."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import langid, piece_scan, quality, secrets, token_binary

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "12 34 !!"), (5, "word " * 30000), (6, "tie"), (6, "tie"), (None, "no id"), (7, "日本語のテキスト😀 é́"), (8, "x" * 40000)]


# Language ID


def test_langid_learns_and_judges(spark, docs_of):
    r = random.Random(3)
    make = lambda parts: " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(60))
    train = [(k, make(("the", "ing", "er", "on")), "en") for k in range(60)] + [(100 + k, make(("eau", "ou", "ch", "é")), "fr") for k in range(40)] + [(900, None, "de"), (901, "text", None)]
    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.languages == ("en", "fr", "de")[: len(model.languages)] and model.languages[:2] == ("en", "fr")
    got = {x["doc_id"]: x for x in langid.classify(docs_of([(1, make(("the", "ing", "er", "on"))), (2, make(("eau", "ou", "ch", "é"))), (3, None), (4, "12 !"), (5, "zzz qqq")]), model).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3, 4)] == ["en", "fr", "und", "und"]
    assert got[5]["lang_pred"] == "en" and got[5]["coverage"] < langid.MIN_COVERAGE
    assert all(0 <= x["score"] <= 1 for x in got.values()) and got[1]["__text"] == "x"
    assert langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string")).predict("a") == ("und", 0.0, 0.0)


def test_langid_bitmask_holds_every_language_of_a_gram():
    m = langid.LanguageModel(tuple("abcdefghij"), np.zeros((2, 1 << langid.SLOTS_LOG2), np.uint8), np.zeros(10))
    h = langid.grams("hello")
    for lang in (0, 9):
        for at in langid.places(h):
            m.planes[lang // 8, at] |= 1 << (lang % 8)
    counts, n = m.counts("hello")
    assert n == len(h) and counts[0] == counts[9] == n and counts[1] == 0


@pytest.mark.skipif("not __import__('os').path.isdir('/root/testdata/sf0.01')")
def test_langid_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    out = langid.classify(docs, model).filter(langid.held_out(F.col("doc_id"))).collect()
    assert sum(x["lang_pred"] == x["lang"] for x in out) >= 0.97 * len(out) > 100
    assert all(langid.held_out is not None and zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2 for x in out)


# Quality


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {i for k, w in enumerate(windows) if windows.count(w) > 1 for i in (k, k + 1, k + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


@settings(max_examples=200, deadline=None)
@given(st.text("ab \n\t\x1c\x85é#*", max_size=80))
def test_quality_counts_by_brute_force(text):
    assert quality.base_counts(text) == slow_counts(text)


def test_quality_bands_and_edges(docs_of):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(2, 9))) for _ in range(400)]
    clean = " ".join(r.choice(words) for _ in range(2000))
    noise = " ".join("".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(6)) for _ in range(2000))
    repetitive = " ".join(f"{k % 7}{'ab' * 60}{k}" for k in range(300))
    got = {x["doc_id"]: x for x in quality.quality(docs_of([*ODD[:4], (10, clean), (11, noise), (12, repetitive), (13, clean), (13, clean)])).collect()}
    assert got[10]["kept"] and not got[12]["kept"] and not got[12]["base_failed"]
    assert not got[1]["kept"] and got[1]["base_failed"] and got[1]["n_words"] == 0
    assert got[11]["ratio"] > got[10]["ratio"] and got[10]["__text"] == "x"


def test_bands_by_brute_force():
    """The verdict restated: the band of a length by a search from below, whole text first, then the share of bad chunks."""
    import zstandard

    def band(n, bands):
        return next(b for b in bands if b.below is None or n < b.below)

    def slow(data):
        size = lambda x: len(zstandard.ZstdCompressor(level=3).compress(x))
        b = band(len(data), quality.DOCUMENT_BANDS)
        if not b.low <= size(data) / len(data) <= b.high:
            return False
        bad = 0
        for k in range(0, len(data), quality.CHUNK_BYTES) if len(data) > quality.CHUNK_BYTES else ():
            chunk = data[k : k + quality.CHUNK_BYTES]
            c = band(len(chunk), quality.CHUNK_BANDS)
            bad += len(chunk) * (not c.low <= size(chunk) / len(chunk) <= c.high)
        return bad / len(data) <= quality.MAX_BAD_CHUNK_SHARE

    import os

    import zstandard as z

    r, compress = random.Random(4), z.ZstdCompressor(level=quality.LEVEL).compress
    verdicts = set()
    for _ in range(300):
        n = r.choice([70, 150, 250, 300, 700, 1500, 3000, 9000, 20000, 70000])
        words = " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 9))) for _ in range(n // 4)).encode()
        data = r.choice([words, base64.b64encode(os.urandom(n)), b"spam " * (n // 5), words[: n // 2] + base64.b64encode(os.urandom(n // 3))])[:n]
        got = quality.compression(data, compress)[2]
        assert got == slow(data), (n, data[:40])
        verdicts.add((got, len(data) > quality.CHUNK_BYTES))
    assert len(verdicts) == 4
    for n in (150, 200, 250, 1000, 5000, 30000):
        assert not quality.compression(base64.b64encode(os.urandom(n))[:n], compress)[2] and not quality.compression((b"spam " * n)[:n], compress)[2]


def test_quality_rejects_encoded_and_random_text(docs_of):
    r = random.Random(5)
    words = ["".join(r.choice("eeeeettttaaaoooiiinnnsssrrhhldcu") for _ in range(r.randint(1, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))

    def encoded(n):
        text = base64.b64encode(r.randbytes(n * 57)).decode()
        return "\n".join(text[k : k + 76] for k in range(0, len(text), 76))

    noise = " ".join("".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(6)) for _ in range(2000))
    bad = [encoded(n) for n in (53, 106, 1053, 3509)] + [noise, prose(7000) + "\n" + encoded(220) + "\n" + prose(7000)]
    good = [prose(n) for n in (60, 100, 300, 1000, 10000)]
    got = {x["doc_id"]: x for x in quality.quality(docs_of(list(enumerate(bad + good)))).collect()}
    assert not any(x["base_failed"] for x in got.values())
    assert [k for k, x in sorted(got.items()) if x["kept"]] == list(range(len(bad), len(bad + good)))
    assert got[5]["ratio"] < 0.6 < got[0]["ratio"]


# Secrets


def slow_base(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(out)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "Secret", "pass", "word", "=", ": ", '"', "AKIA", "A1B2C3D4E5F6G7", "deadbeef", "0123", " ", "xyz-", "api_", "KEY", "é", "\n"]), max_size=14).map("".join))
def test_secrets_base_by_brute_force(text):
    assert [x for x in secrets.find_secrets(text) if x[0] != "random"] == slow_base(text)


def test_random_runs_and_clean_text(docs_of):
    r = random.Random(2)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    hits = sum(any(k == "random" for k, *_ in secrets.find_secrets("key " + "".join(r.choice(alnum) for _ in range(32)) + " end")) for _ in range(100))
    assert hits >= 95
    for clean in ("version-2-of-the-document-2021-01-02", "customer_account_number_12345", "http-request-handler-v2-beta", "iPhone14ProMaxSilicone2022", "a" * 500 + "1", "1111111111111111a"):
        assert not secrets.find_secrets(clean) or secrets.find_secrets(clean) == slow_base(clean)
    assert secrets.scan_secrets(docs_of(ODD).limit(0)).count() == 0
    got = secrets.scan_secrets(docs_of([*ODD, (20, "token = abcdefghijkl.")]), redacted=True).collect()
    assert len(got) == len(ODD) + 1
    one = next(x for x in got if x["doc_id"] == 20)
    assert one["redacted_text"] == "[SECRET]" and one["secrets"][0]["kind"] == "assign"


def test_recall_by_encoding_and_length():
    """Planted keys of each encoding, letters alone among them, and text in one piece."""
    r = random.Random(9)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    for alphabet in (upper + "234567", upper + lower, upper + lower + "0123456789+/", upper + "0123456789", lower + "0123456789"):
        for n, least in ((16, 0.75), (24, 0.9), (40, 0.97)):
            found = sum(any(k == "random" for k, *_ in secrets.find_secrets("a " + "".join(r.choice(alphabet) for _ in range(n)) + " b")) for _ in range(200))
            assert found >= least * 200, (alphabet, n, found)
    words = "internationalization donaudampfschifffahrtsgesellschaft getElementsByTagNameAndAttribute THISISANUPPERCASESENTENCEWITHOUTSPACES abcdefghijklmnopqrstuvwxyz xxxxxxxxxxxxxxxxxxxxxxxxxxx llanfairpwllgwyngyllgogerychwyrndrobwllllantysiliogogoch"
    for w in words.split():
        assert secrets.find_secrets(f"a {w} b") == [], w


def test_control_by_brute_force():
    """decide() restated: the largest k whose k smallest weighted p-values are within FDR * k / m."""
    r = random.Random(11)
    for _ in range(200):
        tested = [(10 ** -r.uniform(0, 12), 10 ** -r.uniform(0, 4), r.randint(16, 90)) for _ in range(r.randint(1, 12))]
        m, total = len(tested), sum(n for *_, n in tested)
        p = [min(1.0, t / q) / (n * m / total) for t, q, n in tested]
        best = 0
        for k in range(1, m + 1):
            if sum(x <= secrets.FDR * k / m for x in p) >= k:
                best = k
        want = [x <= secrets.FDR * best / m and q >= secrets.ALPHA and best > 0 for x, (_, q, _) in zip(p, tested, strict=True)]
        assert secrets.decide(tested) == want
    assert secrets.decide([]) == []


def test_random_runs_beside_names(docs_of):
    r = random.Random(6)
    standard, url = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + x for x in ("+/", "-_"))
    draw = lambda alphabet, n=40: "".join(r.choice(alphabet) for _ in range(n))
    for before, alphabet, after in (("AWS_SECRET_ACCESS_KEY=", standard, ""), ("sig=", standard, ""), ("AUTH=", standard[:62], "=="), ("DB_CRED=", url, "="), ("my_db-key_", standard, ""), ("https/srv/app/", url, "")):
        hits = 0
        for _ in range(50):
            value = draw(alphabet)
            text = f"set {before}{value}{after} now"
            found = [(a, b) for k, a, b in secrets.find_secrets(text) if k == "random"]
            hits += any(a <= text.index(value) and b >= text.index(value) + len(value + after) for a, b in found) if alphabet != standard or "=" in before else bool(found)
        assert hits >= (44 if "=" in before else 25), (before, hits)
    for clean in ("release_name=version-2-of-the-document-2021-01-02", "path=/usr/share/doc/python3_minimal-10/copyright+notes", "a=b=c=d=1=2=3=4=5=6=7=8", "x" * 20 + "=" * 20 + "1"):
        assert not secrets.find_secrets(clean), clean


def test_battery_rejects_order_and_bias():
    assert min(secrets.battery(list(range(16)) * 3, 16)) < secrets.ALPHA
    assert min(secrets.battery([0] * 40, 16)) < secrets.ALPHA
    assert secrets.infer_encoding("deadbeef01") == "hex" and secrets.infer_encoding("XYZ234") == "base32" and secrets.infer_encoding("a-b_") == "base64url" and secrets.infer_encoding("é") is None


# Token files


def test_token_files_round_trip(spark, docs_of, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    docs = docs_of([*ODD, (-5, "Don't STOP, l'été ½ <|endoftext|> İ a\x1cb")])
    store = token_binary.write_tokens(docs, path, end_id=2, folder=str(tmp_path / "t"))
    got = token_binary.read_tokens(spark, store, with_ids=True).orderBy("start").collect()
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    at = 0
    for g, d in zip(got, rows, strict=True):
        ids = [*plain.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids"]) == (d["doc_id"], at, len(ids), ids)
        assert g["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    empty = token_binary.write_tokens(docs.limit(0), path, end_id=2)
    assert token_binary.read_tokens(spark, empty).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("abeiAEé.,'! \t\u0301\u0327\u0308\u0345\u200d\ufb01\u0130\u00b5\u1e9e\u0391\u03a3\u0915\u093f\u1100\u1161中\u00a0\u2003\x1c<|>"), max_size=20))
def test_words_equal_the_library(word_encoder, text):
    assert word_encoder.encode([text]) == [word_encoder._ids(text)]


@pytest.fixture(scope="module")
def word_encoder():
    return token_binary.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))


def test_token_files_roll(spark, docs_of, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = docs_of([(k, f"some words of document {k} " * 20) for k in range(40)])
    store = token_binary.write_tokens(docs, path, end_id=2, folder=str(tmp_path / "rolled"), file_bytes=300)
    assert store.manifest.count() > 10
    whole = token_binary.read_tokens(spark, token_binary.write_tokens(docs, path, end_id=2)).orderBy("doc_id").collect()
    assert token_binary.read_tokens(spark, store).orderBy("doc_id").collect() == whole
    assert [r["start"] for r in whole][1:] == [r["start"] + r["n_tokens"] for r in whole][:-1]


# Pieces


@pytest.fixture(scope="module")
def vocabulary():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    return piece_scan.Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abcdehinot  \n\tэсл日é😀019.,'ing"), max_size=60))
def test_pieces_equal_the_library(vocabulary, text):
    own, library = vocabulary
    ids = np.frombuffer(own.encode(text), "<u4")
    assert ids.tolist() == library.encode(text)
    assert own.decode(ids) == text


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abcdefghinot in"), min_size=60, max_size=300), st.integers(20, 60))
def test_scan_equals_the_library(vocabulary, text, chunk):
    own, library = vocabulary
    full = piece_scan.MARK + text.replace(" ", piece_scan.MARK)
    at, side, parts = piece_scan.chunk_places(len(full), chunk), 2 * own.longest, []
    for a, b in zip(at, at[1:], strict=False):
        lo, hi = max(0, a - side), min(len(full), b + side)
        parts.append((full[lo:hi], a - lo, b - lo))
    found = [own.transfer(*p) for p in parts]
    matrices = [piece_scan.unflat(piece_scan.flat(m)) for m, *_ in found]
    assert matrices == [m for m, *_ in found]
    states, out = piece_scan.boundary_states(matrices), b""
    for (part, a, b), (_, first, last, middle), entry, exit_ in zip(parts, found, states, states[1:], strict=False):
        head, tail, end = (part, "", b) if first < 0 else (part[:first], part[last:], b - last)
        out += own.backtrace(head, tail, a, end, first, middle, entry, exit_)
    assert np.frombuffer(out, "<u4").tolist() == library.encode(text)
    if len(matrices) > 2:
        left = piece_scan.combine(piece_scan.combine(matrices[0], matrices[1]), matrices[2])
        assert left == piece_scan.combine(matrices[0], piece_scan.combine(matrices[1], matrices[2]))


def test_piece_documents(spark, docs_of, vocabulary):
    _, library = vocabulary
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = docs_of([*ODD, (30, "giant words without end " * 4000), (31, "ab" * 30000)])
    out = piece_scan.decode_documents(piece_scan.encode_documents(docs, path, chunk=1024, fan=3), path).collect()
    key = lambda i, t: (i is None, i or 0, t or "")
    want = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda x: key(*x))
    got = sorted(out, key=lambda r: key(r["doc_id"], r["text"]))
    assert [(r["doc_id"], r["text"]) for r in got] == want
    for r in got:
        assert np.frombuffer(r["packed"], "<u4").tolist() == library.encode(r["text"])
    assert piece_scan.encode_documents(docs.limit(0), path).count() == 0


def test_no_result_depends_on_hidden_state():
    assert hashlib.sha256(repr(secrets.find_secrets("token = 0123456789abcdef0123")).encode()).hexdigest() == hashlib.sha256(repr(secrets.find_secrets("token = 0123456789abcdef0123")).encode()).hexdigest()


def test_full_memos_forget_no_frequent_word(monkeypatch):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    monkeypatch.setattr(piece_scan, "MEMO_WORDS", 40)
    monkeypatch.setattr(piece_scan, "MEMO_UNITS", 40)
    pieces, library, walked = piece_scan.Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path), []
    units = pieces._units
    monkeypatch.setattr(pieces, "_units", lambda text: walked.append(text) or units(text))
    for k in range(300):
        text = f"frequently x{k * 7919}q seen-{k}ly"
        assert list(memoryview(pieces.encode(text)).cast("I")) == library.encode(text)
    assert walked.count(piece_scan.MARK + "frequently") == 1
    assert max(map(len, (pieces.words, pieces.old_words, pieces.units, pieces.old_units))) < 60
