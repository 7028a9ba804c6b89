"""Line dedup, near-duplicate documents, decontamination, components and the pipeline, against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import components, decontam, line_dedup, probminhash
from ledgerloom.runtime import written

R = random.Random(4)
VOCABULARY = ["".join(R.choice("abcdefghijklmno") for _ in range(R.randint(2, 8))) for _ in range(800)]


def sentence(n):
    return " ".join(R.choice(VOCABULARY) for _ in range(n))


class Sets:
    def __init__(self, items):
        self.up = {x: x for x in items}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def changed(text, n):
    words = text.split(" ")
    for _ in range(n):
        words[R.randrange(len(words))] = R.choice(VOCABULARY)
    return " ".join(words)


def test_components(spark):
    edges = [(k + 1, k) for k in range(50)] + [(100, 300), (300, 200)] + [(1000, 1000 + k) for k in range(1, 40)] + [(7, 7)]
    got = {r["id"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(51)}, 100: 100, 200: 100, 300: 100, **{1000 + k: 1000 for k in range(40)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_link_loses_no_link_and_makes_no_square(spark):
    # numbers in one bucket, linked if within 2 of each other: no pivot sees all of it
    values = [3 * k + (k % 2) for k in range(60)] + [1000]
    made = []

    def verify(pairs):
        made.append(pairs.count())
        return pairs.filter(F.col("a") - F.col("b") <= 2)

    def again(ids):
        return written(spark, ids.select(F.explode(F.sequence(F.col("id") - 2, F.col("id"))).alias("bucket"), "id"), "again")

    members = written(spark, spark.createDataFrame([(0, v) for v in values], "bucket long, id long"), "m")
    got = {r["id"]: r["label"] for r in components.link(members, verify, [again]).collect()}
    sets = Sets(values)
    for a in values:
        for b in values:
            if a - 2 <= b < a:
                sets.join(a, b)
    linked = {v for v in values if sum(abs(v - w) <= 2 for w in values) > 1}
    assert got == {v: sets.root(v) for v in linked}
    assert sum(made) < len(values) ** 2 / 4


def edited_family(n, words, least, most):
    """n copies of one text, each with some words replaced by words of its own: alike to the text, far less to one another."""
    base = [R.choice(VOCABULARY) for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for at in R.sample(range(words), R.randint(least, most)):
            own[at] = "".join(R.choice("pqrstuvwxyz") for _ in range(7))
        out.append(" ".join(own))
    return [" ".join(base), *out]


@pytest.mark.parametrize("what", ["lines", "documents"])
def test_pairs_of_a_family_do_not_grow_with_the_square(docs_of, monkeypatch, what):
    made, link = [], components.link
    module = line_dedup if what == "lines" else probminhash

    def counting(members, verify, refile):
        def counted(pairs):
            made.append(pairs.count())
            return verify(pairs)

        return link(members, counted, refile)

    monkeypatch.setattr(module, "link", counting)
    per_member = []
    for n in (150, 600):
        made.clear()
        texts = edited_family(n, 40, 3, 7) if what == "lines" else edited_family(n, 150, 3, 6)
        if what == "lines":
            assert kept_by_operator(docs_of, texts) == kept_by_grams(texts)
        else:
            got = {r["doc_id"]: r["group_id"] for r in probminhash.group_documents(docs_of(list(enumerate(texts)))).collect()}
            assert got == fast_groups(texts)
        per_member.append(sum(made) / n)
    # measured: 7.5 and 16.8 pairs a member among documents, a power of 0.6 of the family's size; all pairs would grow with a power of 1
    assert per_member[1] < 4**0.75 * per_member[0], per_member


@pytest.mark.parametrize("few", [0, 1 << 40])
def test_the_way_of_a_bucket_changes_no_link(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few, raising=False)
    members = written(spark, spark.createDataFrame([(v // 20, v) for v in range(60)], "bucket long, id long"), "m")

    def again(ids):  # 19 and 20 meet here alone, which no bucket given has
        return written(spark, ids.select(F.explode(F.sequence(F.col("id") - 1, F.col("id"))).alias("bucket"), "id"), "again")

    got = {r["id"]: r["label"] for r in components.link(members, lambda pairs: pairs.filter("a - b = 1"), [again]).collect()}
    assert got == {v: v // 20 * 20 for v in range(60)}


def test_a_filing_meets_inside_the_buckets_given_alone(spark, monkeypatch):
    tables, write = [], components.written

    def counting(spark, df, name):
        out = write(spark, df, name)
        tables.append(out.count())
        return out

    monkeypatch.setattr(components, "written", counting)
    members = written(spark, spark.createDataFrame([(v // 12, v) for v in range(240)], "bucket long, id long"), "m")
    again = lambda ids: written(spark, ids.select(F.lit(0).cast("long").alias("bucket"), "id"), "again")  # noqa: E731  all in one
    assert components.link(members, lambda pairs: pairs.filter("false"), [again]).count() == 0
    assert max(tables) <= 20 * 12 * 11 / 2, max(tables)  # 240 ids make 28,680 pairs


def test_a_filing_is_not_repeated_for_every_bucket_given(spark, monkeypatch):
    tables, write = [], components.written

    def counting(spark, df, name):
        out = write(spark, df, name)
        if name == "filed":
            tables.append(out.count())
        return out

    monkeypatch.setattr(components, "written", counting)
    members = written(spark, spark.createDataFrame([(b, v) for b in range(30) for v in range(20)], "bucket long, id long"), "m")
    again = lambda ids: written(spark, ids.select(F.explode(F.sequence(F.col("id") - 1, F.col("id"))).alias("bucket"), "id"), "again")
    got = {r["id"]: r["label"] for r in components.link(members, lambda pairs: pairs.filter("a = b + 1 AND b > 0"), [again]).collect()}
    assert got == {v: 1 for v in range(1, 20)}
    assert tables and max(tables) <= 40, tables  # two rows an id


@pytest.mark.parametrize("what", ["lines", "documents"])
def test_a_pair_of_a_filing_meets_once(docs_of, monkeypatch, what):
    met, link = [], components.link
    module = line_dedup if what == "lines" else probminhash

    def catching(members, verify, refile):
        filed, condition = refile[0](members.select("id").distinct())
        rows = filed.alias("a").join(filed.alias("b"), F.col("a.bucket") == F.col("b.bucket")).filter("a.id < b.id").filter(condition).select(F.col("a.id").alias("x"), F.col("b.id").alias("y"))
        met.append((rows.count(), rows.distinct().count()))
        return link(members, verify, refile)

    monkeypatch.setattr(module, "link", catching)
    texts = edited_family(60, 40, 3, 7) if what == "lines" else edited_family(60, 150, 3, 6)
    if what == "lines":
        assert kept_by_operator(docs_of, texts) == kept_by_grams(texts)
    else:
        assert {r["doc_id"]: r["group_id"] for r in probminhash.group_documents(docs_of(list(enumerate(texts)))).collect()} == fast_groups(texts)
    (rows, pairs), = met
    assert 0 < rows <= 1.2 * pairs, met


def test_turns_have_every_band_once(spark):
    sets = [(n, sorted(R.randrange(-(1 << 63), 1 << 63) for _ in range(n))) for n in (1, 2, 3, 5, 9, 19, 20, 21, 40, 60, 255, 256, 700)]
    df = spark.createDataFrame(sets, "id long, s array<long>")
    shifted = [(f"transform(s, x -> coalesce(shiftleft(x, {k}), 0L))", 6) for k in line_dedup.SHIFTS]
    for turns in (1, 3):
        found = {}
        for r in line_dedup._banded(df, [("s", line_dedup.ANCHORS), *shifted], line_dedup.ROWS, 0.8, turns).collect():
            found.setdefault(r["id"], []).append([x for bands in r[1:] for x in bands if x is not None])
        for n, s in sets:
            runs = [run for run in (8, 4, 2, 1) if n >= (2.5 * run if run > 1 else 0) and (run == 8 or n * 0.8 < 5 * run)]
            want = 0
            for run in runs:  # distinct places where a run after some anchor begins
                for k, anchors in ((0, line_dedup.ANCHORS), *((k, 6) for k in line_dedup.SHIFTS)):
                    ring = [((x << k & (1 << 64) - 1) ^ 1 << 63) - (1 << 63) for x in s]
                    want += len({sum(x < a for x in ring) % n for a in line_dedup._places(anchors)})
            assert sum(map(len, found[n])) == sum(len(set(x)) for x in found[n]) == want, n


def fast_groups(texts):
    """Groups of texts whose shingles do not repeat, by plain Jaccard similarity."""
    grams = []
    for t in texts:
        w = t.split()
        grams.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    sets = Sets(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            shared = len(grams[a] & grams[b])
            if shared >= 0.8 * (len(grams[a]) + len(grams[b]) - shared) - 1e-9:
                sets.join(a, b)
    return {k: sets.root(k) for k in range(len(texts))}


def line_shingles(line):
    return {line[k : k + line_dedup.SHINGLE] for k in range(max(1, len(line) - line_dedup.SHINGLE + 1))}


def slow_lines(docs):
    norm = lambda x: x.strip(" ").lower()
    first = {}
    for i, t in sorted((d for d in docs if d[1] is not None), key=lambda d: (d[0] is not None, d[0] or 0)):
        for n, x in enumerate(t.split("\n")):
            if norm(x):
                first.setdefault(norm(x), (i is not None, i or 0, n))
    keys = sorted(first)
    s = {x: line_shingles(x) for x in keys}
    sets = Sets(keys)
    for k, a in enumerate(keys):
        for b in keys[:k]:
            shared = len(s[a] & s[b])
            if shared >= 0.8 * (len(s[a]) + len(s[b]) - shared):
                sets.join(a, b)
    best = {}
    for x in keys:
        best[sets.root(x)] = min(best.get(sets.root(x), first[x]), first[x])
    keep = set(best.values())
    return [(i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if not norm(x) or (i is not None, i or 0, n) in keep)) for i, t in docs]


def test_lines_by_brute_force(spark, docs_of):
    lines = [sentence(R.randint(3, 40)) for _ in range(60)]
    docs = []
    for k in range(60):
        own = [changed(R.choice(lines), R.randint(0, 2)) for _ in range(R.randint(1, 5))]
        docs.append((k, "\n".join([*own, "", " "][: R.randint(1, 7)])))
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "UPPER " + lines[0]), (104, "upper " + lines[0]), (105, "https://a.example/" + "x" * 90), (106, "https://a.example/" + "y" * 90), (107, "日本語" * 40), (108, "short"), (109, "short"), (None, "short")]
    got = line_dedup.dedup_lines(docs_of(docs).withColumn("__lines", F.lit(1)).withColumn("n_removed", F.lit("clash")))
    assert got.columns.count("n_removed") == 1 and "__lines" in got.columns
    want = slow_lines(docs)
    rows = {(r["doc_id"]): r for r in got.collect()}
    assert len(rows) == len(docs)
    for i, t in want:
        assert rows[i]["text"] == t, i
    assert rows[100]["n_lines"] == 0 and rows[109]["n_removed"] == 1


def kept_by_grams(texts):
    """Which one-line documents keep their line, by character 5-grams; stated without the operator's code."""
    norm = [x.strip(" ").lower() for x in texts]
    grams = [{x[k : k + 5] for k in range(max(1, len(x) - 4))} for x in norm]
    sets = Sets(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                sets.join(a, b)
    return [k for k in range(len(texts)) if sets.root(k) == k]


def kept_by_operator(docs_of, texts):
    return sorted(r["doc_id"] for r in line_dedup.dedup_lines(docs_of(list(enumerate(texts)))).collect() if r["n_removed"] == 0)


def test_near_equal_lines_by_character_grams(docs_of):
    texts = ["The committee approved the annual budget after a long debate on Tuesday.", "The committee approved the annual budgat after a long debate on Tuesday."]
    blob = "".join(R.choice("0123456789abcdef") for _ in range(150))
    texts += [blob, blob[:70] + "z" + blob[71:], "吾輩は猫である名前はまだ無いどこで生れたかとんと見当がつかぬ" * 3, "吾輩は犬である名前はまだ無いどこで生れたかとんと見当がつかぬ" * 3]
    for n in (3, 8, 12, 20, 30):
        for _ in range(8):
            line = sentence(n)
            at = R.randrange(len(line))
            texts += [line, line[:at] + "z" + line[at + 1 :]]
    want = kept_by_grams(texts)
    assert 0 in want and 1 not in want and 3 not in want
    assert kept_by_operator(docs_of, texts) == want


def test_candidates_are_hashed_once_and_compared_by_generated_code(docs_of, monkeypatch):
    """Sizes of sets come from the bands, and shared shingles are counted outside of lambdas. Pairs at just 0.8 are linked, those under it are not."""
    plans, write = {}, line_dedup.written

    def noting(spark, df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().analyzed().toString())
        return write(spark, df, name)

    monkeypatch.setattr(line_dedup, "written", noting)
    monkeypatch.setattr(components, "written", noting)
    texts, own = [], random.Random(8)
    for k in range(16):  # of 40 shingles in all 32 are shared, or of 41 only 31
        line = "".join(own.sample("abcdefghijklmnopqrstuvwxyz0123456789äöüßéèàç", 40))
        texts += [line, line[:36] + "+-=*" if k % 2 else line[:35] + "+-=*#"]
    texts += ["aaaa bbbb " * 9, "aaaa bbbb " * 30, "ab", "ba"]
    want = kept_by_grams(texts)
    assert [k for k in range(1, 32, 2) if k in want] == list(range(1, 32, 4)) and 33 not in want
    assert kept_by_operator(docs_of, texts) == want
    (sets,) = plans["line-sets"]
    assert "xxhash64" not in sets, sets
    assert plans["links"] and not any("exists(" in p for p in plans["links"])


def test_recall_of_edited_lines(docs_of):
    """Pairs of lines at 0.8 to 0.86, of any length: at least 0.95 are found."""
    texts, found = [], 0
    while len(texts) < 400:
        line = sentence(R.choice([2, 4, 8, 15, 30, 60, 200]))
        other = list(line)
        grams = line_shingles(line)
        for at in R.sample(range(len(other)), len(other)):
            other[at] = R.choice("0123456789")
            new = line_shingles("".join(other))
            if len(grams & new) < 0.8 * len(grams | new):
                break
            last = "".join(other)
            if len(grams & new) <= 0.86 * len(grams | new):
                texts += [line, last]
                break
    kept = set(kept_by_operator(docs_of, texts))
    found = sum(k + 1 not in kept for k in range(0, len(texts), 2))
    assert found >= 0.95 * len(texts) / 2, found


def test_lines_with_distinct_tails_stay(docs_of):
    texts = ["acknowledgement: alice", "acknowledgement: bob", "internationalization failed hard", "internationalization passed easy", "x" * 12 + " a", "x" * 12 + " b", "abcd", "abce", "ab", "a"]
    want = kept_by_grams(texts)
    assert {0, 1, 2, 3, 6, 7, 8, 9} <= set(want)
    assert kept_by_operator(docs_of, texts) == want


def test_lines_of_empty_tables_and_repeated_rows(docs_of):
    assert line_dedup.dedup_lines(docs_of([]) if False else docs_of([(1, "a")]).limit(0)).count() == 0
    out = line_dedup.dedup_lines(docs_of([(1, "one line here"), (1, "one line here"), (2, "one line here")])).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == ["one line here", "one line here", ""]


def slow_groups(docs):
    bags = {}
    for i, t in docs:
        w = t.encode().split()
        n = min(5, len(w))
        bags[i] = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else Counter()
    sets = Sets([i for i, _ in docs])
    for k, (a, ta) in enumerate(docs):
        for b, tb in docs[:k]:
            if ta == tb or slow_similarity(bags[a], bags[b]) >= 0.8 - 1e-9:
                sets.join(a, b)
    return {i: sets.root(i) for i, _ in docs}


def slow_similarity(p, q):
    if not p or not q:
        return 0.0
    return sum(1 / sum(max(p[y] / p[x], q[y] / q[x]) for y in p.keys() | q.keys()) for x in p.keys() & q.keys())


def test_probability_jaccard():
    for _ in range(50):
        p, q = (Counter({R.randrange(12): R.randint(1, 4) for _ in range(R.randint(1, 9))}) for _ in range(2))
        import numpy as np

        a, b = (np.array(sorted(x), np.uint64) for x in (p, q))
        wa, wb = (np.array([x[k] for k in sorted(x)], float) for x in (p, q))
        assert probminhash.probability_jaccard(a, wa, b, wb) == pytest.approx(slow_similarity(p, q))


def test_signatures_estimate_probability_jaccard():
    import numpy as np

    a = np.arange(1, 41, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    b, wa = a[8:], np.array([3.0 if k % 4 == 0 else 1.0 for k in range(40)])
    wb = np.ones(32)
    n = 4096
    same = np.mean(probminhash.signature(np.sort(a), wa[np.argsort(a)], n) == probminhash.signature(np.sort(b), wb[np.argsort(b)], n))
    order = np.argsort(a), np.argsort(b)
    assert abs(same - probminhash.probability_jaccard(a[order[0]], wa[order[0]], b[order[1]], wb[order[1]])) < 0.04
    h, c = probminhash.shingles("a b c d e a b c d e a b c d e")
    k, w = probminhash.unpack(probminhash.pack(h, c))
    assert len(k) == 5 and sorted(w.tolist()) == sorted(c.tolist()) and max(c) > 1


def test_recall_of_banding():
    for s in (0.8, 0.85, 0.9):
        assert (1 - s**probminhash.ROWS) ** probminhash.BANDS <= (1 - s**4) ** 16  # no more missed than by 4 rows x 16 bands


def near_documents():
    base = [sentence(R.randint(40, 120)) for _ in range(15)]
    docs = [(k, changed(R.choice(base), R.randint(0, 3))) for k in range(70)]
    docs += [(200, ""), (201, ""), (202, " \n"), (203, "one two"), (204, "one two"), (205, "one two three"), (206, base[0] + " " + base[0])]
    return docs


def test_groups_by_brute_force(spark, docs_of):
    docs = near_documents()
    got = {r["doc_id"]: r for r in probminhash.group_documents(docs_of([*docs, (300, None), (301, None)])).collect()}
    want = slow_groups(docs)
    assert {i: got[i]["group_id"] for i, _ in docs} == want
    assert got[300]["group_id"] == 300 and got[301]["group_size"] == 1
    assert got[docs[0][0]]["group_size"] == sum(v == want[docs[0][0]] for v in want.values())
    assert probminhash.group_documents(docs_of([(1, "a")]).limit(0)).count() == 0


def test_one_of_each_group_stays(docs_of):
    docs = near_documents()
    out = probminhash.drop_near_duplicates(docs_of([*docs, docs[0], (None, docs[0][1]), (300, None), (301, None)])).collect()
    want = slow_groups(docs)
    kept = [r["doc_id"] for r in out]
    assert len(kept) == len(set(kept))
    first = want[docs[0][0]]
    assert {k for k in kept if k is not None and k < 300 and want[k] != first} == {v for v in want.values() if v != first}
    assert 300 in kept and 301 in kept and sum(k is not None and k < 300 and want[k] == first for k in kept) <= 1


def test_documents_with_null_or_equal_ids_stay(docs_of):
    a, b, c, d, e, f = (sentence(60) for _ in range(6))
    rows = [(None, a), (None, b), (None, b), (None, c), (7, d), (7, e), (3, changed(e, 1)), (8, f), (8, f), (None, None), (None, None)]
    out = Counter((r["doc_id"], r["text"]) for r in probminhash.drop_near_duplicates(docs_of(rows)).collect())
    assert out == Counter([(None, a), (None, b), (None, c), (7, d), rows[6], (8, f), (None, None), (None, None)])


def slow_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_leaks_by_brute_force(spark, docs_of):
    items = [(k, sentence(R.randint(8, 30))) for k in range(12)] + [(50, None), (51, ""), (52, "tiny"), (53, "Twenty letters or so, yes!")]
    docs, plain = [], lambda t: "".join(chr(c) for c in decontam.normal(t)[0].tolist())
    for k in range(60):
        item = R.choice(items[:12])[1]
        s = list(item.upper() if k % 7 == 0 else item)
        for _ in range(R.randint(0, len(s) // 12)):
            at, what = R.randrange(len(s)), R.random()
            s[at : at + 1] = [] if what < 0.3 else [s[at], "z"] if what < 0.6 else ["q"]
        docs.append((k, f"{sentence(R.randint(0, 30))}\n{''.join(s)}! {sentence(R.randint(0, 30))}" if k % 3 else sentence(60)))
    docs += [(100, None), (101, ""), (102, items[1][1]), (102, items[1][1]), (103, "so: TWENTY letters, or so; yes"), (104, (items[2][1] + " ") * 3)]
    got = Counter((r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs_of(docs), spark.createDataFrame(items, "item_id long, text string")).collect())
    want = Counter()
    for i, t in docs:
        for j, item in items:
            found = decontam.plan(len(plain(item or "")))
            if t and found and slow_edits(plain(item), plain(t)) <= found[1]:
                want[i, j] += 1
    assert got == want and got[102, 1] == 2
    clean = decontam.drop_leaks(docs_of(docs), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(i for i, _ in docs if not any(k[0] == i for k in want))
    assert decontam.find_leaks(docs_of(docs), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_alignment_by_brute_force():
    import numpy as np

    for _ in range(60):
        item, text = ("".join(R.choice("abc") for _ in range(R.randint(3, 12))) for _ in range(2))
        text = text * 2
        a, b = (np.array([ord(c) for c in x], np.uint32) for x in (item, text))
        edits, end = decontam.align([a, a], b, [-len(item), 0], [len(item) * 2 + len(text), 1], [len(item), 0])
        assert edits[0] == slow_edits(item, text) and 0 <= end[0] <= len(text)
        assert edits[1] == (0 if text.startswith(item) else 1)


def test_items_with_a_common_instruction_cost_little():
    import time

    instruction = "answer the following question with the letter of the one right choice of the four"
    plain = lambda n: " ".join("".join(R.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(R.randint(2, 8))) for _ in range(n))
    items = [(k, f"{instruction} {plain(12)}") for k in range(2000)]
    index = decontam.build([*items, (5000, items[0][1])])
    text = " ".join(f"{plain(10)} {instruction}" for _ in range(100))
    decontam.matches("warm " + items[1][1], index)
    began = time.process_time()
    assert decontam.matches(text, index) == []
    found = decontam.matches(f"{text} {items[7][1][:-1]}q {items[0][1]}", index)
    assert time.process_time() - began < 2
    assert [(index.items[k].ids, e) for k, _, _, e in found] == [([0, 5000], 0), ([7], 1)]


def test_short_items_match_as_whole_words():
    index = decontam.build([(1, "Paris, France"), (2, "art")], short=True)
    assert [index.items[k].ids for k, *_ in decontam.matches("In paris france we start.", index)] == [[1]]
    assert [index.items[k].ids for k, *_ in decontam.matches("the ART of parisfrance", index)] == [[2]]
    assert decontam.build([(1, "Paris, France")]).items == []


def test_blocks_cover_all_items(spark, docs_of, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 100)
    items = spark.createDataFrame([(k, sentence(12)) for k in range(9)], "item_id long, text string")
    docs = docs_of([(r["item_id"], f"see {r['text']} there") for r in items.collect()])
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, items).collect()) == [(k, k) for k in range(9)]
    assert decontam.drop_leaks(docs, items).count() == 0


def test_pipeline_stages(spark, tmp_path):
    items = [(k, sentence(20)) for k in range(3)]
    texts = [sentence(80) for _ in range(30)]
    docs = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    docs += [(100, texts[0], "en", "s", 1), (101, changed(texts[1], 2), "en", "s", 1), (102, f"{sentence(30)} {items[0][1]} {sentence(9)}", "en", "s", 1), (103, None, "en", "s", 0), (104, "12345", "en", "s", 5), (105, "\n".join([texts[2], sentence(50)]), "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {*range(30), 105}
    assert all(len(r["tokens"]) == 4 * r["n_tokens"] for r in out.values())
    import numpy as np
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert np.frombuffer(out[0]["tokens"], "<u4").tolist() == library.encode(texts[0])
    assert np.frombuffer(out[105]["tokens"], "<u4").tolist() == library.encode(docs[-1][1].split("\n")[1])
