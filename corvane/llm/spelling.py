"""Spelling variants: words one code point apart, found by a self-join of tries with active nodes.

Two words one edit apart, the shorter of c code points, agree either in the first half of those c or in the last. So each
word goes to four tries: for c its own length and one less, one trie of all words with its first half and one of all with
its last, each over the part of the word that is left. Rows are dealt and sorted by that fixed part, and a task builds the
tries of as many whole groups as its memory allows, level by level in arrays. Down the levels it carries, for every node,
the active nodes one edit away: siblings (a code point replaced) and children (one inserted), and whichever of their
descendants the next code points lead to. Where two ends meet, they are a pair. Pairs stay in the task; what leaves it is
one row a word and group: how many near words, and the most frequent of them.

A fixed part that many words share is no hot key: groups above GROUP code points are split by halves of what is left, again
and again, down to a single code point, where a group can't be larger than the alphabet. A pair that agrees in both halves
belongs to the first.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import LOWER, drop, materialize, table

MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: Words held in a task before they go on; code points in a task's tries; code points of a group that is split.
HELD, BATCH, GROUP = 200_000, 2_000_000, 1_000_000
LETTERS = "A-Za-zÀ-ÿ"
#: One run in so many, by the hash of document and run, loses a code point.
DAMAGED = 31


def damaged(doc_id, run: str) -> str:
    """The run, without the code point h % length where h, the crc32 of `id:run`, is divisible by DAMAGED. A null id is empty."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run[: h % len(run)] + run[h % len(run) + 1 :] if run and h % DAMAGED == 0 else run


def _count(min_length: int, spoil: bool):
    # A run of fewer code points can't give a word, and this pattern finds longer ones from their start to their end.
    runs = re.compile(f"[{LETTERS}]{{{min_length},}}")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for part in parts:
            for doc_id, text in zip(part.column(0), part.column(1), strict=True):
                own, doc_id = Counter(runs.findall((text.as_py() or "").encode().translate(LOWER).decode())), doc_id.as_py()
                for word, n in own.items():
                    if len(word := damaged(doc_id, word) if spoil else word) >= min_length:
                        counts[word] += n
                if len(counts) >= HELD:
                    yield _counted(counts)
                    counts.clear()
        yield _counted(counts)

    return run


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, spoil: bool = False) -> DataFrame:
    """(word, n): the lower-cased (A-Z) letter runs of whole texts and how often each occurs; null texts have none, repeated
    rows count each. With spoil, runs first lose a code point where `damaged` says so."""
    found = docs.select(F.col(doc_id), F.col(text)).mapInArrow(_count(min_length, spoil), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _halves(words: DataFrame) -> DataFrame:
    """The rows of `words` (c, pre, mid, suf, append, n) with half of what is left (mid) fixed: once the first, once the last.
    mid has m code points, or one more in words longer than c. append: whether a pair of mid and mid with one code point
    appended counts here; it doesn't where the first half would hold it too."""
    m = F.col("c") - F.char_length("pre") - F.char_length("suf")
    first, size = F.floor(m / 2).cast("int"), F.char_length("mid")
    rest = (m - first).cast("int")
    front = words.select("c", F.concat("pre", F.substring("mid", F.lit(1), first)).alias("pre"), F.substring("mid", first + 1, size).alias("mid"), "suf", "append", "n")
    back = words.select("c", "pre", F.substring("mid", F.lit(1), size - rest).alias("mid"), F.concat(F.substring("mid", size - rest + 1, rest), F.col("suf")).alias("suf"), F.lit(False).alias("append"), "n")
    return front.unionByName(back)


def _grouped(vocab: DataFrame, group: int) -> DataFrame:
    """Each word by the four (or more) fixed parts under which it is compared, in groups of at most `group` code points, or of
    words that differ in one place only."""
    size, nothing = F.char_length("word"), F.lit("")
    least = vocab.agg(F.min(size)).first()[0] or 1
    classes = F.explode(F.sequence(F.greatest(size - 1, F.lit(least)), size))
    rows = _halves(vocab.select(classes.alias("c"), nothing.alias("pre"), F.col("word").alias("mid"), nothing.alias("suf"), F.lit(True).alias("append"), "n"))
    key = ["c", "pre", "suf"]
    while True:
        left = F.col("c") - F.char_length("pre") - F.char_length("suf")
        hot = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("words")).where((F.col("words") * left > group) & (left > 1)).select(*key)
        hot = materialize(hot, "hot")
        if hot.isEmpty():
            return rows
        rows = materialize(rows.join(hot, key, "left_anti").unionByName(_halves(rows.join(hot, key, "left_semi"))), "split")


def levels(mids: np.ndarray, lengths: np.ndarray, groups: np.ndarray) -> list[dict]:
    """The tries of rows sorted by group and mid, by depth: for each node its parent, code point, first child (and the end of
    the last) and the row that ends there, or -1. mids: code points, a line a row."""
    out, node, active = [], groups, np.arange(len(groups))
    last = np.unique(groups, return_index=True)[1]
    end = np.full(len(last), -1)
    end[groups[lengths == 0]] = np.flatnonzero(lengths == 0)
    out.append({"parent": np.zeros(len(last), np.int64), "char": np.zeros(len(last), np.uint32), "end": end})
    for depth in range(1, int(lengths.max(initial=0)) + 1):
        deep = lengths[active] >= depth
        active, parent = active[deep], node[deep]
        char = mids[active, depth - 1]
        new = np.ones(len(active), bool)
        new[1:] = (parent[1:] != parent[:-1]) | (char[1:] != char[:-1])
        node = np.cumsum(new) - 1
        end = np.full(int(new.sum()), -1)
        ends = lengths[active] == depth
        end[node[ends]] = active[ends]
        out.append({"parent": parent[new], "char": char[new], "end": end})
    for upper, lower in zip(out, [*out[1:], {"parent": np.zeros(0, np.int64)}], strict=True):
        upper["child"] = np.searchsorted(lower["parent"], np.arange(len(upper["end"]) + 1))
    return out


def _down(trie: list[dict], depth: int, u: np.ndarray, v: np.ndarray, v_depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every child of u with the child of v by the same code point, and the v it came from."""
    nothing = np.zeros(0, np.int64)
    if v_depth + 1 >= len(trie) or not len(u):
        return nothing, nothing, nothing
    first, last = trie[depth]["child"][u], trie[depth]["child"][u + 1]
    n = last - first
    line = np.repeat(np.arange(len(u)), n)
    lower = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n) + first[line]
    below = trie[v_depth + 1]
    # Children of one node have rising code points, so node and code point together rise too.
    keys = below["parent"].astype(np.int64) << 21 | below["char"]
    wanted = v[line].astype(np.int64) << 21 | trie[depth + 1]["char"][lower]
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return lower[hit], at[hit], v[line][hit]


def near_rows(trie: list[dict], shorter: np.ndarray, append: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, row) whose mids are one edit apart. shorter: a row's mid has the length of its group's shorter words; a pair
    needs one. append: a row's group counts pairs of mid and mid with one code point appended."""
    none = np.zeros(0, np.int64)
    same, longer = (none, none), (none, none)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for depth, level in enumerate(trie):
        below = trie[depth + 1] if depth + 1 < len(trie) else None
        if below is not None:
            # The node itself is active at no distance, so its children are at one.
            children = np.arange(len(below["parent"]))
            longer = np.concatenate([longer[0], below["parent"]]), np.concatenate([longer[1], children])
        a, b = level["end"][same[0]], level["end"][same[1]]
        both = (a >= 0) & (b >= 0)
        both[both] = shorter[a[both]]
        found.append((a[both], b[both]))
        if below is None:
            break
        a, b = level["end"][longer[0]], below["end"][longer[1]]
        both = (a >= 0) & (b >= 0)
        both &= (below["parent"][longer[1]] != longer[0]) | append[a]
        both[both] = shorter[a[both]]
        found.append((a[both], b[both]))
        u, v, _ = _down(trie, depth, *same, depth)
        siblings = [(u, v)]
        for step in range(1, len(below["parent"])):
            one = np.flatnonzero(below["parent"][step:] == below["parent"][:-step])
            if not len(one):
                break
            siblings.append((one, one + step))
        same = tuple(np.concatenate(x) for x in zip(*siblings, strict=True))
        u, v, above = _down(trie, depth, *longer, depth + 1)
        # A child of the node itself is active anyway.
        fresh = above != u
        longer = u[fresh], v[fresh]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none)


_NEAR = "word string, n_near long, form string, form_n long"


def _join(block: pa.Table) -> pa.RecordBatch:
    """For each word of whole groups of rows its near words' number and the most frequent of them."""
    c, pre, mid, suf, append, n = (block.column(x).combine_chunks() for x in ("c", "pre", "mid", "suf", "append", "n"))
    c, n, append = c.to_numpy(), n.to_numpy(), append.to_numpy(zero_copy_only=False)
    groups = np.cumsum(_starts(block)) - 1
    lengths = pc.utf8_length(mid).to_numpy()
    width = max(1, int(lengths.max(initial=0)))
    mids = np.array(mid.to_pylist(), f"<U{width}").view(np.uint32).reshape(len(c), width)
    shorter = pc.utf8_length(pre).to_numpy() + lengths + pc.utf8_length(suf).to_numpy() == c
    a, b = near_rows(levels(mids, lengths, groups), shorter, append)
    of, other = np.concatenate([a, b]), np.concatenate([b, a])
    rows, of, other = np.unique(of), np.searchsorted(np.unique(of), of), np.searchsorted(np.unique(of), other)
    picked = pa.array(rows)
    words = pc.binary_join_element_wise(pre.take(picked), mid.take(picked), suf.take(picked), "").to_pylist()
    place = np.empty(len(rows), np.int64)
    place[sorted(range(len(rows)), key=words.__getitem__)] = np.arange(len(rows))
    n = n[rows]
    order = np.lexsort((place[other], -n[other], of))
    first = np.searchsorted(of[order], np.arange(len(rows)))
    best = other[order][first]
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(np.bincount(of, minlength=len(rows)), pa.int64()), pa.array([words[i] for i in best], pa.string()), pa.array(n[best], pa.int64())], [x.split()[0] for x in _NEAR.split(", ")])


def _starts(block: pa.Table) -> np.ndarray:
    """Whether a row begins another group than the row above."""
    new = np.ones(block.num_rows, bool)
    for name in ("c", "pre", "suf"):
        column = block.column(name).combine_chunks()
        new[1:] = (new[1:] if name != "c" else False) | pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return new


def _near(batch: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for part in parts:
            # Widths within a batch differ by one at most, so that no long word widens the lines of all.
            c = part.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(c)) + 1).tolist(), len(c)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held and held[0].column(0)[0].as_py() != c[lo]:
                    yield _join(pa.Table.from_batches(held))
                    held, size = [], 0
                if hi > lo:
                    held.append(part.slice(lo, hi - lo))
                    size += (hi - lo) * int(c[lo])
            if size >= batch:
                block = pa.Table.from_batches(held)
                last = int(np.flatnonzero(_starts(block))[-1])
                if last:
                    yield _join(block.slice(0, last))
                    held = block.slice(last).to_batches()
                    size = (block.num_rows - last) * int(c[-1])
        if held:
            yield _join(pa.Table.from_batches(held))

    return run


def near_words(vocab: DataFrame, group: int = GROUP, batch: int = BATCH) -> DataFrame:
    """(word, n_near, form, form_n) for every word of vocab (word, n; distinct) with a near word: their number, and the most
    frequent with its n, ties to the smaller in code-point order."""
    key = ["c", "pre", "suf"]
    dealt = _grouped(vocab.where("word <> ''"), group).repartition(*key).sortWithinPartitions(*key, "mid")
    found = dealt.mapInArrow(_near(batch), _NEAR)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): from each word of forms (word, form) along the forms to the last. The way left halves in each round."""
    current = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        following = materialize(current.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        drop(forms.sparkSession, current)
        current = following
        if current.where("moved").isEmpty():
            return current.select("word", "root")


def spelling_variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, spoil: bool = False, group: int = GROUP, batch: int = BATCH) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of at least min_length code points and min_count occurrences.

    Words are maximal runs of Latin letters, A-Z lower-cased. Near words differ by exactly one inserted, deleted or replaced code point. The form is the most frequent
    near word (ties: smallest in code-point order) if it occurs at least ratio times as often as the word, else null; root
    follows forms to the last, and is the word itself without a form. Null and empty texts have no words, a null id counts
    as empty, repeated rows count each, words may be as long as a text, an empty table gives no rows. Other columns aren't read.
    """
    vocab = materialize(vocabulary(docs, text, doc_id, min_length, min_count, spoil), "vocabulary")
    near = near_words(vocab, group, batch)
    has = F.col("form_n") >= F.col("n") * ratio
    words = materialize(vocab.join(near, "word", "left").select("word", F.when(has, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("form_n")).alias("form_n")), "words")
    ends = roots(words.where("form IS NOT NULL"))
    return words.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of all documents, one run in 31 having lost a code point. Nulls, empty and long texts, repeated rows
    and empty tables as in spelling_variants."""
    return spelling_variants(table(spark, sf_dir, "documents"), spoil=True)


OP12_SQL = """
WITH RECURSIVE t AS (
  SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  GROUP BY ALL
), bytes AS (
  SELECT *, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6)::BIGINT, 128 + (unicode(c) & 63)::BIGINT] END)) AS b FROM runs
), hashed AS (
  SELECT run, k, length(run) AS size, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, tab[xor(c & 255, x) + 1])), 4294967295) AS h FROM bytes, t
), vocab AS (
  SELECT word, sum(k)::BIGINT AS n FROM (SELECT k, CASE WHEN h % 31 = 0 THEN left(run, (h % size)::INTEGER) || substring(run, (h % size)::INTEGER + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), cut AS (
  SELECT word, i, left(word, i::INTEGER) || substring(word, i::INTEGER + 2) AS k FROM (SELECT word, unnest(range(length(word))) AS i FROM vocab)
), near AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
  UNION SELECT cut.word, vocab.word FROM cut JOIN vocab ON cut.k = vocab.word
  UNION SELECT vocab.word, cut.word FROM cut JOIN vocab ON cut.k = vocab.word
), best AS (
  SELECT near.word, other, v.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near FROM near JOIN vocab v ON v.word = other
  QUALIFY row_number() OVER (PARTITION BY near.word ORDER BY v.n DESC, other) = 1
), forms AS (
  SELECT vocab.word, vocab.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * vocab.n THEN other END AS form, CASE WHEN other_n >= 10 * vocab.n THEN other_n END AS form_n FROM vocab LEFT JOIN best USING (word)
), ways AS (
  SELECT word, word AS root FROM forms UNION ALL SELECT ways.word, form FROM ways JOIN forms ON forms.word = ways.root WHERE form IS NOT NULL
)
SELECT forms.word, forms.form, ways.root, forms.n, forms.n_near, forms.form_n FROM forms JOIN ways USING (word) JOIN forms last ON last.word = ways.root WHERE last.form IS NULL
"""
