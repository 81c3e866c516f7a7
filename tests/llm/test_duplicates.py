"""Line groups, shingle groups and components against brute force."""

import random
import re

from pyspark.sql import functions as F

from corvane.llm import jaccard as J
from corvane.llm import line_dedup as L
from corvane.llm.common import LOWER
from corvane.llm.components import components


def find(parent, a):
    while parent.setdefault(a, a) != a:
        a = parent[a]
    return a


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102), (7, 7), (300, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def variants(r, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(r.randint(0, edits)):
            words[r.randrange(len(words))] = f"n{r.randint(0, 10**6)}"
        out.append(" ".join(words))
    return out


def sets_of(text):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard(spark, docs, empty):
    r = random.Random(5)
    texts = []
    for g in range(12):
        texts += variants(r, [f"g{g}w{k}" for k in range(r.randint(30, 90))], 14, 4)
    shared = " ".join(f"p{k}" for k in range(60))
    texts += [f"{shared} " + " ".join(f"o{i}x{k}" for k in range(r.randint(1, 60))) for i in range(40)]
    texts += ["one two", "ONE  two", "two one", "one two three", None, "", "a b c d e", texts[0], texts[0]]
    rows = [(1000 - i, t, "x") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, component_id string").repartition(5)
    sets = {i: sets_of(t) for i, t, _ in rows}
    parent = {}
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(parent, i), find(parent, j)
                parent[max(x, y)] = min(x, y)
    want = {i: (len(s), find(parent, i)) for i, s in sets.items()}
    assert {q["doc_id"]: (q["n_shingles"], q["component_id"]) for q in J.link_groups(frame).collect()} == want
    kept = J.keep_one(frame)
    assert kept.columns == frame.columns and {q["doc_id"] for q in kept.collect()} == {c for _, c in want.values()}
    assert J.link_groups(empty).count() == 0
    mixed = {(q["doc_id"], q["component_id"]) for q in J.link_groups(docs).collect()}
    assert {(1, 1), (7, 1), (2, 2), (3, 3), (9, 9)} <= mixed and J.link_groups(docs).count() == 11


def test_keep_one_of_repeated_rows(spark):
    """Equal rows of one id leave one; rows of one id with other texts are documents of their own; extra columns stay."""
    rows = [(5, "a b c d e f", "x"), (5, "a b c d e f", "x"), (5, "q r s t u v", "y"), (7, "a b c d e f", "z"), (None, "q r s t u v", "w"), (8, None, "n"), (8, None, "n"), (9, " ", "n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, component_id string").coalesce(1)
    got = [tuple(q) for q in J.keep_one(frame).collect()]
    assert sorted(got, key=str) == sorted([rows[0], rows[2], rows[5], rows[6], rows[7]], key=str)


def test_common_shingles(spark):
    """Shingles in most sets of all tasks come last; packing them loses nothing."""
    import numpy as np

    halves = np.sort(np.random.default_rng(1).integers(0, 1 << 32, 1000).astype(np.uint32))
    assert (J._from_planes(J._planes(halves)) == halves).all() and len(J._from_planes(J._planes(halves[:0]))) == 0
    rows = [(i, f"common words that every text has own{i} own{i}a own{i}b own{i}c") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    maker, blocks = J.Shingles(), 4
    packed = frame.select("doc_id", "text").mapInArrow(J._profile(J.WORDS, blocks), "doc_id long, cls long, n long, block int, packed binary").where("packed is not null").select("block", "packed")
    top = {r["key"]: r["sets"] for r in packed.repartitionById(blocks, "block").sortWithinPartitions("block").mapInArrow(J._most_common(10), "key long, sets long").collect()}
    common = J._key(maker.sets([b"common words that every text has"])[0], blocks).astype(np.int64).tolist()
    assert {k for k, n in top.items() if n == 40} == set(common)


def test_shared_shingles_beyond_the_list(spark, monkeypatch):
    """Shingles that several sets share aren't columns of sets that have enough of their own, however short the list of common
    ones is; with too few bits to mark them all, the same documents link."""
    passages = [" ".join(f"p{g}w{k}" for k in range(12)) for g in range(60)]
    texts = [" ".join([*(f"d{i}w{k}" for k in range(40)), passages[i % 60], passages[(i * 7 + 1) % 60]]) for i in range(240)]
    texts += [f"{texts[3]} more", f"{texts[4]} more words"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    made = []

    def counted(df, name, *rest, write=J.materialize):
        out = write(df, name, *rest)
        if name == "columns":
            made.append(out.count())
        return out

    monkeypatch.setattr(J, "materialize", counted)
    monkeypatch.setattr(J, "COMMON", 4)
    want = {i: {240: 3, 241: 4}.get(i, i) for i in range(len(texts))}
    assert {q["doc_id"]: q["component_id"] for q in J.link_groups(frame).collect()} == want
    assert made[-1] < 100, made
    monkeypatch.setattr(J, "MARK_BITS", 256)
    assert {q["doc_id"]: q["component_id"] for q in J.link_groups(frame).collect()} == want


def test_pairs_of_a_large_group(spark, monkeypatch):
    """Copies of one text, no two alike, make pairs in proportion to their number, and lose no link."""
    r = random.Random(8)
    base = [f"w{k}" for k in range(100)]
    texts = [" ".join(base)]
    for i in range(300):
        copy = list(base)
        for k in r.sample(range(100), 2 + i % 2):
            copy[k] = f"n{i}x{k}"
        texts.append(" ".join(copy))
    made = []

    def counted(products, bounded=J._bounded):
        made.append(products.count())
        return bounded(products)

    monkeypatch.setattr(J, "_bounded", counted)
    got = {q["doc_id"]: q["component_id"] for q in J.link_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)).collect()}
    sets, parent = [sets_of(t) for t in texts], {}
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = find(parent, i), find(parent, j)
                parent[max(x, y)] = min(x, y)
    assert got == {i: find(parent, i) for i in range(len(texts))} and made[0] < 10 * len(texts), made


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_line_dedup(spark, docs, empty):
    r = random.Random(7)
    lines = []
    for g in range(8):
        lines += variants(r, [f"g{g}w{k}" for k in range(40)], 6, 1)
    lines += ["Short", "short!", "---", "", "other line of several plain words here"]
    r.shuffle(lines)
    rows = [(i, "\n".join(lines[i * 5 : i * 5 + 5]), "c") for i in range(11)] + [(50, None, "c"), (51, "---\n\n---", "c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_lines string").coalesce(1)
    flat = [(i, k, re.sub(r"[\W_]+", " ", line.lower()).strip()) for i, t, _ in rows if t is not None for k, line in enumerate(t.split("\n"))]
    norms = sorted({n for *_, n in flat if n})
    parent = {}
    for a in norms:
        for b in norms:
            if a < b and min(len(a.split()), len(b.split())) >= L.MIN_WORDS and edit_distance(a, b) <= int(max(len(a), len(b)) * (1 - L.EDIT)):
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    seen, want = set(), {}
    for i, t, _ in rows:
        kept = None if t is None else []
        for j, k, n in flat:
            if i == j:
                if not n or find(parent, n) not in seen:
                    kept.append(t.split("\n")[k])
                seen |= {find(parent, n)} if n else set()
        want[i] = None if kept is None else "\n".join(kept)
    assert {q["doc_id"]: q["text"] for q in L.dedup_lines(frame).collect()} == want
    assert any(parent[n] != n for n in parent)
    assert L.dedup_lines(empty).count() == 0 and L.dedup_lines(docs).count() == 11
    left = L.without_repeats(docs)
    assert left.columns == docs.columns and {q["doc_id"] for q in left.collect()} == {1, 2, 3, 4, 5, 6, 8, None, 9}


def test_line_recall(spark):
    """Near copies of lines of 5 to 100 words, judged by edit similarity alone: whole words replaced, left out or put in."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8)))
    common = [word() for _ in range(60)]
    rows, near = [], {}
    for n in (5, 6, 8, 9, 10, 12, 15, 20, 23, 30, 40, 60, 100):
        for i in range(30):
            base = [r.choice(common) if r.random() < 0.5 else word() for _ in range(n)]
            copy = list(base)
            for k in sorted(r.sample(range(n), r.randint(1, max(1, n // 10))), reverse=True):
                copy[k : k + 1] = [[word()], [], [copy[k], word()]][i % 3]
            a, b = " ".join(base), " ".join(copy)
            rows += [(len(rows), a), (len(rows) + 1, b)]
            if min(len(base), len(copy)) >= L.MIN_WORDS and edit_distance(a, b) <= int(max(len(a), len(b)) * (1 - L.EDIT)):
                near[len(rows) - 1] = n
    rows += [(len(rows), " ".join(["ha"] * 9)), (len(rows) + 1, " ".join(["ha"] * 10))]
    near[len(rows) - 1] = 9
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {q["doc_id"] for q in L.dedup_lines(frame).where("n_removed > 0").collect()}
    assert len(near) > 250 and not gone - set(near)
    for n in set(near.values()):
        own = {i for i in near if near[i] == n}
        assert len(own & gone) >= 0.9 * len(own), n
    assert len(gone) >= 0.97 * len(near)


def typo(r, s):
    """s with one letter replaced, left out or put in."""
    k, kind = r.choice([i for i, c in enumerate(s) if c != " "]), r.randrange(3)
    return s[:k] + ("" if kind == 1 else r.choice("abcdefghijklmnopqrstuvwxyz")) + s[k + (kind != 2) :]


def lost(spark, pairs):
    """Of pairs (kind, a, b) of lines within the threshold, how many of each kind there are and how many stay."""
    near = [(kind, a, b) for kind, a, b in pairs if a != b and edit_distance(a, b) <= int(max(len(a), len(b)) * (1 - L.EDIT))]
    frame = spark.createDataFrame([(2 * i + j, line) for i, (_, *both) in enumerate(near) for j, line in enumerate(both)], "doc_id long, text string").coalesce(1)
    gone = {q["doc_id"] for q in L.dedup_lines(frame).where("n_removed > 0").collect()}
    kinds = sorted({kind for kind, *_ in near})
    return {kind: (sum(k == kind for k, *_ in near), sum(k == kind and 2 * i + 1 not in gone for i, (k, *_) in enumerate(near))) for kind in kinds}


def test_line_typos(spark):
    """Typing errors in short and long lines, short words replaced, lines of few words and without spaces."""
    r = random.Random(11)
    word = lambda a=3, b=9: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(a, b)))
    pairs = []
    for n in (1, 2, 3, 4, 6, 8, 9, 10, 12, 15, 20, 40, 60):
        for edits in (1, 2, 3, 4):
            for _ in range(12):
                a = b = " ".join(word() for _ in range(n))
                for _ in range(edits):
                    b = typo(r, b)
                pairs.append((("typos", n, edits), a, b))
    for n in (25, 40, 60, 150, 210):
        for _ in range(10):
            words = [word() for _ in range(n)]
            pairs.append((("each fifth", n), " ".join(words), " ".join(typo(r, w) if i % 5 == 2 else w for i, w in enumerate(words))))
    for n in (12, 20, 40):
        for _ in range(10):
            words = [word(1, 3) for _ in range(n)]
            copy = list(words)
            copy[r.randrange(n)] = word(1, 3)
            pairs.append((("short words", n), " ".join(words), " ".join(copy)))
    for n in (20, 40, 100):
        for _ in range(10):
            a = b = "".join(chr(0x4E00 + r.randrange(2000)) for _ in range(n))
            for _ in range(max(1, n // 40)):
                k = r.randrange(n)
                b = b[:k] + chr(0x4E00 + r.randrange(2000)) + b[k + 1 :]
            pairs.append((("no spaces", n), a, b))
    found = lost(spark, pairs)
    assert all(gone == 0 for (kind, n, *_), (_, gone) in found.items() if kind == "typos" and n <= 12)
    assert all(gone <= 0.1 * most for most, gone in found.values())


def test_simhash(spark):
    """Bits are the majority of the pieces' bits, in short and in long lines; fingerprints within SIM_BITS share a key."""
    r = random.Random(2)
    sets = [[r.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 3, 10, 511, 512, 700)]
    want = [sum((sum(h >> b & 1 for h in hs) * 2 > len(hs)) << b for b in range(63)) for hs in sets]
    frame = spark.createDataFrame([(i, hs) for i, hs in enumerate(sets)], "id int, h array<long>")
    assert [q[0] for q in frame.orderBy("id").select(L.simhash(F.col("h"))).collect()] == want
    rows = []
    for _ in range(100):
        x = r.getrandbits(63)
        rows.append(([x], [x ^ sum(1 << b for b in r.sample(range(63), L.SIM_BITS))]))
    pairs = spark.createDataFrame(rows, "a array<long>, b array<long>")
    assert pairs.where(~F.arrays_overlap(L.simhash_keys(F.col("a")), L.simhash_keys(F.col("b")))).count() == 0


def test_long_lines(spark):
    """Lines of thousands of words: a tenth of the words changed stays within bounds, a third doesn't."""
    r = random.Random(4)
    base = [f"word{r.randint(0, 10**6)}" for _ in range(4000)]
    tenth, third = list(base), list(base)
    for k in r.sample(range(4000), 400):
        tenth[k] = f"other{k}"
    for k in r.sample(range(4000), 1330):
        third[k] = f"thing{k}"
    tenth.insert(2000, "inserted")
    del tenth[100]
    frame = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(tenth)), (3, " ".join(third))], "doc_id long, text string")
    assert {q["doc_id"]: q["n_removed"] for q in L.dedup_lines(frame).collect()} == {1: 0, 2: 1, 3: 0}


def test_counts_that_are_columns_already(spark):
    """without_repeats gives back columns of any name as they were; dedup_lines replaces those of its counts."""
    docs = spark.createDataFrame([(1, "one line of text\none line of text", 99, "mine", "kept"), (2, None, 98, "mine", "kept")], "doc_id long, text string, n_lines int, gone string, row string")
    assert {tuple(q) for q in L.without_repeats(docs).collect()} == {(1, "one line of text", 99, "mine", "kept"), (2, None, 98, "mine", "kept")}
    assert {(q["doc_id"], q["n_lines"], q["n_removed"]) for q in L.dedup_lines(docs).collect()} == {(1, 2, 1), (2, 0, 0)}


def test_simhash_of_every_line(spark):
    """Lines of any length have every key of their SimHash, odd ones; short words don't vote beside longer ones; lines that share
    such a key are compared by their whole fingerprints, those that share another key always."""
    lines = ["short", "abc def", "one two three four five", "some words of a line that is long enough for all kinds of keys"]
    frame = spark.createDataFrame([(x,) for x in lines], "norm string").withColumn("sim", L.fingerprint(F.split("norm", " ")))
    parts = frame.select("sim", L.fingerprint_keys(F.col("sim")).alias("own"), *[k.alias(f"p{i}") for i, k in enumerate(L.block_keys(F.col("norm"), F.col("sim")))])
    for q in parts.collect():
        assert len(q["own"]) == 10 and all(k % 2 for k in q["own"]) and {k for k in q["p0"] if k % 2} == set(q["own"])
        assert not any(k % 2 for k in q["p1"] or [])
    votes = spark.createDataFrame([("gamma river stone cloud of the",), ("gamma river stone cloud in an a",), ("gamma river of the",), ("gamma river in an",)], "norm string")
    a, b, c, d = [q[0] for q in votes.coalesce(1).select(L.fingerprint(F.split("norm", " "))).collect()]
    assert a == b and c != d
    far = (1 << L.SIM_FAR + 1) - 1
    pairs = spark.createDataFrame([(1, 0, far), (1, 0, far >> 1), (2, 0, far)], "key long, a long, b long")
    assert [q[0] for q in pairs.coalesce(1).select(L._close(F.col("key"), F.col("a"), F.col("b"))).collect()] == [False, True, True]


def test_sketches_only_bound(spark):
    """A sketch passes every pair that the text would, and stops most others; a pair is made by one of its shared keys."""
    r = random.Random(21)
    base = [" ".join("".join(r.choice("abcdefghijklmnoprstuw") for _ in range(r.randint(1, 12))) for _ in range(r.choice([3, 8, 30, 120, 500]))) for _ in range(30)]
    rows = []
    for line in base:
        for edits in (1, len(line) // 12, len(line) // 7):
            copy = list(line)
            for _ in range(edits):
                at = r.randrange(len(copy))
                copy[at : at + 1] = r.choice([[], [r.choice("eé ")], [copy[at], "x"]])
            rows.append((line, " ".join("".join(copy).split())))
        rows += [(line, other) for other in base if other != line and abs(len(other) - len(line)) < 0.15 * max(len(line), len(other))]
    pairs = spark.createDataFrame(rows, "x string, y string").distinct()
    longest = F.greatest(F.length("x"), F.length("y"))
    u, v = F.split("x", " "), F.split("y", " ")
    common = F.size(F.array_intersect(u, v)) >= L.COMMON * F.greatest(F.size(F.array_distinct(u)), F.size(F.array_distinct(v)))
    near = (F.levenshtein("x", "y") <= F.floor(longest * (1 - L.EDIT))) & (common | (F.least(F.length("x"), F.length("y")) <= L.SEGMENTED))
    got = pairs.select(near.alias("near"), L._sketch(F.col("x")).alias("a"), L._sketch(F.col("y")).alias("b"), "x").where(F.length("x") <= L.LONG).select("near", L._may_be_near(F.col("a"), F.col("b")).alias("may")).groupBy("near", "may").count().collect()
    n = {(q["near"], q["may"]): q["count"] for q in got}
    assert n.get((True, False), 0) == 0 and n[True, True] > 40 and n[False, False] > 3 * n.get((False, True), 0), n
    shared = spark.createDataFrame([(k, a, b) for a in range(6) for b in range(a) for k in range(40)], "k long, a long, b long")
    keyed = shared.select(F.col("k").alias("key"), F.struct("a", F.sequence(F.lit(0), F.lit(31)).alias("first"), F.col("k").alias("key")).alias("x"), F.struct("b", F.sequence(F.lit(0), F.lit(31)).alias("first")).alias("y"))
    assert keyed.where(L._by_first("x.", "y.")).select("x.a", "y.b").count() == 15


def test_shuffles_go_as_tables_are_written(spark):
    """What a written table's query shuffled is deleted, and the setting is put back as it was."""
    import glob
    import os

    from corvane.llm.common import _CLEANUP, drop, materialize

    def held():
        return sum(os.path.getsize(p) for p in glob.glob(os.path.join(folder, "**", "shuffle_*.data"), recursive=True))

    folder = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    before, setting = held(), spark.conf.get(_CLEANUP)
    out = materialize(spark.range(1 << 20).groupBy(F.xxhash64("id").alias("h")).agg(F.max("id").alias("m")), "shuffled")
    assert out.count() == 1 << 20 and held() - before < 1 << 20 and spark.conf.get(_CLEANUP) == setting
    drop(spark, out)
