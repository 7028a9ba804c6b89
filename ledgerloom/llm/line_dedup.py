r"""Line dedup by MinHash over character shingles, with DataFrame and SQL functions only.

Lines are compared trimmed and in lower case. A line's shingles are the windows of SHINGLE characters (code points) at every character,
with or without spaces; a shorter line is one shingle. Equal lines collapse by 128 bits of hash. Distinct lines get MinHash signatures;
lines that agree in a band are candidates; exact Jaccard similarity of the shingle sets (as 64-bit hashes) verifies them; connected
components keep their first line, by doc_id, then line number.

Signatures: every shingle is hashed once, and a band is ROWS values that follow an anchor in the sorted hashes, round the end: the
smallest ones of a rotated permutation, so two lines agree in it with about the probability similarity^ROWS. Sets of fewer than SMALL
shingles have too few separate runs for that; they are also ordered by other bits of their hashes (more permutations). Sets under 20
shingles take shorter runs, by classes of size, and those just above a class's border are filed in both, so that similar lines always
share a class.

Recall of banding, by simulation: 0.98 or more at a similarity of 0.8 (1,000 shingles 0.980, 300 0.995, fewer 0.993 to 1.00), 1.00 from
0.85 on. No link between lines that share a band is lost (see components.link).

Plan: documents are written once, bucketed by a 128-bit key of doc_id and text; the three later passes over texts (distinct lines,
candidates, the result) join small per-document lists to that table without moving texts. Hot lines are pre-aggregated before the
shuffle, and their copies never reach the bands. Distinct lines get unique numbers, which the bands carry.

Defined results: null text stays null; blank lines always stay; a text keeps its other lines in order. Rows equal in doc_id and text are
one document and get the same text. Null doc_id sorts first. Empty tables give no rows. Other columns are kept; the operator's own
names (n_lines, n_removed) replace clashing ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import components
from ledgerloom.llm.common import fresh, session
from ledgerloom.llm.components import first_met, fits, link, shared_buckets
from ledgerloom.runtime import forget, later, scratch_path, written

SHINGLE = 5
SIMILARITY = 0.8
#: The longest run of a band, and the anchors of the first permutation.
ROWS, ANCHORS = 8, 24
#: Sets of fewer shingles have more permutations, by how far each shifts the hashes, with so many anchors each.
SMALL, SHIFTS, SMALL_ANCHORS = 256, (18, 29, 40), 6
#: A set takes a run only with at least so many times as many shingles; smaller ones take runs of half the length, and so on.
PER_RUN = 2.5


def _norm(line: Column) -> Column:
    return F.lower(F.trim(line))


def _hashes(norm: str) -> str:
    """SQL of the hashes of a line's shingles, with repetitions. UTF-32 makes a window a slice at a known place."""
    windows = f"transform(sequence(1, greatest(length(u) - {4 * SHINGLE - 4}, 1), 4), k -> xxhash64(substring(u, k, {4 * SHINGLE})))"
    return f"get(transform(array(encode({norm}, 'UTF-32')), u -> {windows}), 0)"


def _set(norm: str) -> str:
    return f"array_distinct({_hashes(norm)})"


def _sorted(lines: DataFrame) -> DataFrame:
    """lines with s, the sorted distinct hashes of norm's shingles, in place of norm."""
    return lines.withColumn("s", F.expr(f"sort_array(array_distinct({_hashes('norm')}))")).drop("norm")


def _classes(rows: int, similarity: float) -> list[tuple[int, str]]:
    """The runs by size of a set, and SQL of whether a set of s is filed by them: similar sets share at least one."""
    runs, out = [rows], []
    while runs[-1] > 1:
        runs.append(runs[-1] // 2)
    for k, run in enumerate(runs):
        least = f"size(s) >= {PER_RUN * run}" if run > 1 else "true"
        out.append((run, f"{least} AND size(s) * {similarity} < {PER_RUN * runs[k - 1]}" if k else least))
    return out


def _places(anchors: int) -> list[int]:
    """So many even places over all signed 64-bit numbers, in order."""
    step = (1 << 64) // anchors
    return [k * step + step // 3 - (1 << 63) for k in range(anchors)]


def _banded(sets: DataFrame, permutations: list[tuple[str, int]], rows: int, similarity: float, turns: int, sized: bool = False) -> DataFrame:
    """id and arrays of bucket keys (or nulls), one for each turn, of sets (id, s); sized: size, too, that of s. permutations: SQL of the array of s that each orders, and its anchors.

    Each projection has a function that code generation leaves out: the generated code of a whole stage would be one method too long to
    be compiled, while projections by themselves are split into short ones.
    """
    own = F.expr("get(transform(array(id), x -> x), 0)").alias("id")
    names, size = range(len(permutations)), ["size"] if sized else []
    runs = ", ".join(f"CASE WHEN {within} THEN array({run}) ELSE cast(array() as array<int>) END" for run, within in _classes(rows, similarity))
    filed = sets.select("id", *[F.size("s").alias(c) for c in size], "s", F.expr(f"explode(concat({runs}))").alias("run"))
    ordered = filed.select("id", *size, "run", *[F.expr(p if p == "s" else f"sort_array({p})").alias(f"p{k}") for k, (p, _) in enumerate(permutations)])  # s is sorted
    marks = [f"array({', '.join(f'{a}L' for a in _places(n))})" for _, n in permutations]
    ring = ordered.select(own, *size, "run", *[F.expr(f"size(p{k})").alias(f"n{k}") for k in names], *[F.expr(f"concat(p{k}, slice(p{k}, 1, {rows}))").alias(f"r{k}") for k in names], *[F.expr(f"sort_array(concat(p{k}, {marks[k]}))").alias(f"m{k}") for k in names])
    # of the anchor's place among values and anchors, the anchors before it are taken off: that is where its run begins
    at = {(k, j): F.expr(f"cast(array_position(m{k}, {a}L) as int) - {j}").alias(f"b{k}_{j}") for k, (_, n) in enumerate(permutations) for j, a in enumerate(_places(n))}
    begins = ring.select(own, *size, "run", *[x for k in names for x in (f"n{k}", f"r{k}")], *at.values())
    # anchors without a value between them have one run, and those past the last value have the first one's
    new = lambda k, j: f"n{k} > 0" + (f" AND b{k}_{j} <> b{k}_{j - 1} AND (b{k}_{j} <= n{k} OR b{k}_0 > 1)" if j else "")
    keyed = begins.select(own, *size, *[F.expr(f"CASE WHEN {new(k, j)} THEN xxhash64({k}, run, slice(r{k}, b{k}_{j}, run)) END").alias(f"k{k}_{j}") for k, j in at])
    dealt = [[f"k{k}_{j}" for k, j in at][t::turns] for t in range(turns)]
    return keyed.select(own, *size, *[F.array(*mine).alias(f"bands{t}") for t, mine in enumerate(dealt)])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, drop_emptied: bool = False) -> DataFrame:
    """docs with each near-equal line kept once in all of them, and n_lines, n_removed.

    drop_emptied leaves out documents that lose all their lines that are not blank. The result reads written tables; runtime.sweep(spark) deletes them once it is no longer needed.
    """
    spark = session(docs)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept_cols = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    key, key2 = fresh(docs, "__key"), fresh(docs, "__second")
    name = f"ledgerloom_lines_{uuid.uuid4().hex}"
    ids = [F.col(f"`{id_col}`"), F.col(f"`{text_col}`")]
    keyed = docs.select(*(F.col(f"`{c}`") for c in kept_cols)).withColumn(key, F.xxhash64(*ids)).withColumn(key2, F.xxhash64(F.lit(1), *ids))
    keyed.repartition(n, key, key2).write.format("parquet").option("path", scratch_path(spark, "lines")).option("compression", "zstd").bucketBy(n, key, key2).saveAsTable(name)
    forget(spark)
    later(spark, name)
    stored = spark.table(name)
    texts = stored.select(F.col(key).alias("key"), F.col(key2).alias("key2"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.split(F.col(f"`{text_col}`"), "\n").alias("lines"))

    # Equal lines, by two hashes: the first occurrence of each, numbered.
    every = texts.select("key", "key2", "doc_id", F.posexplode("lines").alias("line_no", "line")).withColumn("norm", _norm(F.col("line"))).filter("norm <> ''")
    hashed = every.select(F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2"), F.struct("doc_id", "key", "key2", "line_no").alias("at"))
    first = hashed.groupBy("h1", "h2").agg(F.min("at").alias("at")).select(F.monotonically_increasing_id().alias("id"), "at.*")
    first = written(spark, first, "first-lines")
    later(spark, first)
    forget(spark)

    def lines_of(rows: DataFrame) -> DataFrame:
        """id, norm of rows (key, key2, line_no, id), read from the stored texts."""
        per = rows.groupBy("key", "key2").agg(F.collect_list(F.struct("line_no", "id")).alias("wanted"))
        found = texts.select("key", "key2", "lines").join(per.hint("shuffle_hash"), ["key", "key2"]).select("lines", F.explode("wanted").alias("w"))
        return found.select(F.col("w.id").alias("id"), _norm(F.expr("get(lines, w.line_no)")).alias("norm"))

    small = [(f"transform(CASE WHEN size(s) < {SMALL} THEN s ELSE cast(array() as array<bigint>) END, x -> coalesce(shiftleft(x, {k}), 0L))", SMALL_ANCHORS) for k in SHIFTS]
    bands = written(spark, _banded(_sorted(lines_of(first)), [("s", ANCHORS), *small], ROWS, similarity, components.TURNS, sized=True), "bands")
    forget(spark)
    members = shared_buckets(bands.drop("size"))

    # The candidates' lines and the sizes of their shingle sets (the sets are several times larger than the lines), and verification.
    met = members.select("id").distinct()
    sizes = bands.select("id", F.col("size").alias("n")).join(met, "id", "left_semi").distinct()  # a set filed by two runs has two rows
    sets = written(spark, lines_of(first.join(met, "id", "left_semi")).join(sizes, "id"), "line-sets")
    forget(spark, bands)

    def verify(pairs: DataFrame) -> DataFrame:
        left, right = (sets.select(F.col("id").alias(x), F.col("norm").alias(f"norm_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
        both = pairs.join(left, "a").join(right, "b").filter(F.least("n_a", "n_b") >= F.lit(similarity) * F.greatest("n_a", "n_b"))  # no pair of other sizes can be as similar
        # of shared >= similarity * (n_a + n_b - shared), with shared once: a lambda about it would have it computed without generated code
        shared = F.expr(f"size(array_intersect({_hashes('norm_a')}, {_hashes('norm_b')}))")
        return both.filter(shared * F.lit(1 + similarity) + 1e-9 >= F.lit(similarity) * (F.col("n_a") + F.col("n_b"))).select("a", "b")

    def again(ids: DataFrame) -> tuple[DataFrame, Column]:
        """Lines by the rarest of their shingles, which all lines that are similar share; common ones of the lines asked for come last."""
        asked = written(spark, sets.join(ids, "id", "left_semi").select("id", F.expr(_set("norm")).alias("s")), "again")
        every = asked.select("id", F.size("s").alias("size"), F.explode("s").alias("x"))
        shared = every.groupBy("x").agg(F.count("*").alias("often")).filter("often > 1")
        # v: the shingles that others have too, rarest first; all others come before them
        ordered = every.join(shared, "x").groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("often", "x"))).alias("v"))
        # similar sets share one of those that come before the last SIMILARITY of the set
        first = ordered.select("id", "size", F.size("v").alias("others"), F.expr(f"transform(slice(v, 1, greatest(size(v) - cast(ceil({similarity} * size - 1e-6) as int) + 1, 0)), v -> v.x)").alias("v"))
        placed = first.select("id", "size", "others", "v", F.posexplode("v").alias("k", "bucket"))
        before = F.expr(f"slice(v, greatest(k - {components.BEFORE}, 0) + 1, least(k, {components.BEFORE}))").alias("before")
        n = F.col("others") - F.col("k")
        filed = written(spark, placed.select("bucket", "id", (n / F.col("size")).alias("left"), n.alias("n"), (1 / F.col("size")).alias("top"), before), "filed")
        forget(spark, asked)
        return filed, fits("a", "b", similarity) & first_met("a", "b")

    labels = link(members, verify, [again])
    forget(spark, members, sets)

    # Every component keeps its first line.
    placed = first.join(labels, "id")
    best = placed.groupBy("label").agg(F.min(F.struct("doc_id", "key", "key2", "line_no", "id")).alias("best"))
    lost = written(spark, placed.join(best, "label").filter("id <> best.id").select("id"), "lost-lines")
    later(spark, lost)
    forget(spark, labels)
    kept_, done_ = (fresh(docs, x) for x in ("__kept", "__done"))
    keep = first.join(lost, "id", "left_anti").groupBy("key", "key2").agg(F.collect_list("line_no").alias(kept_))
    keep = keep.select(F.col("key").alias(f"{key}_"), F.col("key2").alias(f"{key2}_"), kept_)
    stays = stored.join(keep.hint("shuffle_hash"), (F.col(key) == F.col(f"{key}_")) & (F.col(key2) == F.col(f"{key2}_")), "left")
    if drop_emptied:  # kept lines are not blank
        stays = stays.filter(F.col(kept_).isNotNull() | (F.trim(F.replace(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit("\n"), F.lit(" "))) == ""))
    # the text is split once: what a lambda refers to by name would be computed anew for every line
    at = f"array_sort(concat(coalesce(`{kept_}`, cast(array() as array<int>)), filter(sequence(0, size(ls) - 1), k -> trim(get(ls, k)) = '')))"
    found = f"named_struct('text', array_join(transform(at, k -> get(ls, k)), '\n'), 'n', size(ls), 'left', size(at))"
    stays = stays.withColumn(done_, F.expr(f"get(flatten(transform(array(split(`{text_col}`, '\n')), ls -> transform(array({at}), at -> {found}))), 0)"))
    there = F.col(f"`{text_col}`").isNotNull()
    out = [F.when(there, F.col(f"{done_}.text")).alias(text_col) if c == text_col else F.col(f"`{c}`") for c in kept_cols]
    number, left = F.when(there, F.col(f"{done_}.n")).otherwise(0), F.when(there, F.col(f"{done_}.left")).otherwise(0)
    return stays.select(*out, number.cast("long").alias("n_lines"), (number - left).cast("long").alias("n_removed"))
