"""Nulls, empty and very long texts, ties and repeated rows, empty tables and clashing columns, operator by operator."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from ledgerloom import runtime
from ledgerloom.llm import chat, decontam, langid, line_dedup, probminhash, warc

R = random.Random(21)
WORDS = ["".join(R.choice("abcdefghijklmno") for _ in range(R.randint(2, 8))) for _ in range(900)]


def sentence(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def test_chat_ties_repeats_and_long_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "assistant", "b"), (1, 0, "assistant", "b"), (1, 0, "user", "a")]
    rows += [(2, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(60)]
    rows += [(3, 0, "user", "long " * 100_000), (3, 1, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_conversations(df)).collect()}
    tied = sorted((t, r, x) for c, t, r, x in rows if c == 1)
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in tied).encode()).hexdigest()
    assert got[1]["loss_chars"] == 2 and got[2]["n_turns"] == 60
    assert got[2]["loss_sha256"] == hashlib.sha256("".join(f"turn {k}" for k in range(1, 60, 2)).encode()).hexdigest()
    assert got[3]["loss_chars"] == 1 and got[3]["formatted_chars"] > 500_000


def test_warc_of_long_payloads(spark):
    long = "payload é " * 300_000
    pages = spark.createDataFrame([(1, "http://a/", long), (2, "http://b/", long), (3, None, None), (4, "http://d/" + "u" * 70_000, "")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.read_warc(warc.write_warc(pages)).filter("gap_reason IS NULL").collect()}
    assert got[2]["payload_bytes"] == len(long.encode()) and got[1]["refers_to"] == 2 and set(got) == {1, 2, 3, 4}
    assert warc.read_warc(warc.write_warc(pages.limit(0))).count() == 0


def test_langid_of_repeats_long_texts_and_empty_tables(spark, docs_of):
    train = [(k, sentence(40), "en") for k in range(40)] + [(100 + k, " ".join(w.upper() + "ß" for w in sentence(40).split()), "xx") for k in range(40)]
    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    rows = [(1, train[0][1]), (1, train[0][1]), (2, train[0][1] * 300), (3, "")]
    got = langid.classify(docs_of(rows), model).collect()
    assert len(got) == 4 and [r["lang_pred"] for r in sorted(got, key=lambda r: r["doc_id"])] == ["en", "en", "en", "und"]
    assert langid.classify(docs_of(rows).limit(0), model).count() == 0
    one = langid.fit(spark.createDataFrame(train + [(999, "other text", "zz")], "doc_id long, text string, lang string"), max_languages=2)
    assert set(one.languages) == {"en", "xx"}


def test_language_counts_equal_plain_sets(spark):
    """The bitmask's popcounts against sets of n-grams: never fewer, and corrected to about the same."""
    train = [(k, sentence(30), "aa") for k in range(30)] + [(100 + k, " ".join(w[::-1] + "q" for w in sentence(30).split()), "bb") for k in range(30)]
    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"), min_share=0.0)
    sets = {}
    for lang in ("aa", "bb"):
        n = Counter(int(h) for _, t, x in train if x == lang for h in np.unique(langid.grams(t)))
        sets[lang] = {h for h, c in n.items() if c >= 2}
    for text in (train[0][1], train[-1][1], sentence(20)):
        h = np.unique(langid.grams(text))
        want = [sum(int(x) in sets[lang] for x in h) for lang in model.languages]
        assert model.languages[int(np.argmax(want))] == model.predict(text)[0]


@pytest.mark.parametrize("what", ["lines", "groups", "leaks"])
def test_very_long_texts(spark, docs_of, what):
    long = "\n".join(sentence(12) for _ in range(4000))
    blob = "z" * 300_000
    rows = [(1, long), (2, long[: len(long) // 2] + " tail"), (3, blob), (4, blob + "y"), (5, None), (6, ""), (None, long)]
    if what == "lines":
        got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs_of(rows)).collect()}
        assert got[None]["text"] == long and got[1]["n_removed"] == 4000 and got[4]["n_removed"] + got[3]["n_removed"] == 0 and got[5]["text"] is None
        runtime.sweep(spark)
    elif what == "groups":
        got = {r["doc_id"]: r["group_id"] for r in probminhash.group_documents(docs_of(rows)).collect()}
        assert got[1] == got[None] == 1 and got[2] == 2 and got[3] == 3 and got[5] == 5
    else:
        items = spark.createDataFrame([(7, " ".join(long.split()[-40:])), (8, "nowhere " * 9)], "item_id long, text string")
        assert sorted((r["doc_id"] or 0, r["item_id"]) for r in decontam.find_leaks(docs_of(rows), items).collect()) == [(0, 7), (1, 7)]


def test_pipeline_of_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, class_id string, n_lines string, h1 long, packed string"
    texts = [sentence(60) for _ in range(4)]
    rows = [(1, texts[0], "en", "s", 1, "c", "n", 1, "p"), (1, texts[0], "en", "s", 1, "c", "n", 1, "p"), (1, texts[1], None, None, None, None, None, None, None), (None, texts[2], "en", "s", 1, "c", "n", 1, "p"), (4, None, None, None, None, None, None, None, None), (5, "", "en", "s", 0, "", "", 0, ""), (6, "long " + " ".join(sentence(50) for _ in range(300)), "en", "s", 1, "c", "n", 1, "p")]
    rows += [(100 + k, sentence(80), "en", "s", 1, "c", "n", 1, "p") for k in range(25)]  # teach the language
    for name, data, bench in (("full", rows, []), ("empty", [], [(1, sentence(20))])):
        folder = tmp_path / name
        spark.createDataFrame(data, schema).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "full")).collect()
    assert Counter(r["doc_id"] for r in out) == Counter([1, 1, None, 6, *range(100, 125)])
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    long = next(r for r in out if r["doc_id"] == 6)
    assert np.frombuffer(long["tokens"], "<u4").tolist() == library.encode(rows[6][1])


def test_sweep_deletes_what_results_have_read(spark, docs_of):
    out = line_dedup.dedup_lines(docs_of([(1, "a line of words"), (2, "a line of words")])).select("doc_id", "text").collect()
    assert sorted(r["text"] for r in out) == ["", "a line of words"]
    before = len([t for t in spark.catalog.listTables() if t.name.startswith("ledgerloom_lines")])
    runtime.sweep(spark)
    assert before and not [t for t in spark.catalog.listTables() if t.name.startswith("ledgerloom_lines")]


def test_decoding_loads_no_vocabulary(monkeypatch):
    import numpy as np
    import public_tokenizers

    from ledgerloom.llm import piece_scan

    model = public_tokenizers.path("piece_bpe_32k.model")
    ids = np.frombuffer(piece_scan.loaded(model).encode("decoding stands alone"), "<u4")
    monkeypatch.setattr(piece_scan, "_LOADED", {})
    assert piece_scan.decoder(model).decode(ids) == "decoding stands alone" and not piece_scan._LOADED


def test_learning_in_small_parts_changes_nothing(spark, docs_of, monkeypatch):
    import numpy as np

    from ledgerloom.llm import langid

    docs = docs_of([(k, f"the cat number {'abcdefghij'[k % 10]} sat there") for k in range(40)])
    whole = langid.fit(docs)
    monkeypatch.setattr(langid, "HELD_GRAMS", 1)
    parts = langid.fit(docs)
    assert whole.languages == parts.languages and np.array_equal(whole.planes, parts.planes) and whole.planes.any()
