"""N-gram Jaccard join as a blocked sparse matrix product of documents by word shingles.

Rows of the incidence matrix are classes of documents with the same shingle set; columns are 64-bit hashes of shingles.
1. A document's set is reduced to its prefix: n - ceil(0.75 n) + 1 shingles in an order that puts common ones last. Two
   sets with similarity 0.75 share a shingle of both prefixes, whatever the order, so the order changes speed but never results.
   Shingles are counted over the whole corpus. Those in one set only come first, told by a bit for each shingle in several
   (a filter of bounded size); then those in few; last the most common, a bounded list, by their counts. Where the bits hold
   all shingles in several sets, those in one set are no columns, as they are shared with no other row, and aren't shuffled.
2. Prefix columns are dealt out in blocks by the hash of their smallest row. A block multiplies its columns: it accumulates for each pair of rows
   how many prefix shingles they share. Sums over blocks are compared with the bound that the sizes give: shared prefix
   shingles plus the larger rest must reach ceil(0.75 / 1.75 * (n + m)); pairs below are discarded.
3. What remains is verified on whole sets.
First come STAR_ROUNDS in which a row is compared with one row only: of the leaders of its columns (first the row that shares
most columns with others, which in a group of copies is what they were made from, then one by chance) the one it shares most
columns with, outside its own component. That joins large groups of near copies at a cost that
grows with the rows. Then all pairs of a column whose rows aren't in one component follow. So no link between different
sets is lost, and a group of near copies doesn't make all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import LOWER, drop, fresh, materialize, shuffle_width, table
from corvane.llm.components import components

WORDS = 5
SIMILAR = (75, 100)
#: At most so many shingles are marked as common: of each block of hashes, its share of those in most sets.
COMMON = 1 << 19
COMMON_SETS = 2
#: Bits that mark shingles of COMMON_SETS sets or more, a block's share at most: so many for each of them as long as they fit, and
#: never fewer than CROWDED. Of more shingles those in most sets are marked.
MARK_BITS, MARK_WIDTH, CROWDED = 1 << 26, 16, 4
#: Shingles that a task holds before it hands them over.
HELD = 4_000_000
STAR_ROUNDS = 3
#: Bits of the fixed-size filter by which a task recognises sets that may be in a candidate pair (false hits are harmless).
FILTER_BITS = 1 << 23
#: Bytes of text that are hashed at a time.
PIECE = 4 << 20
_PRIME = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
_PAIR = ["a", "b", "na", "nb", "shared"]
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sorted distinct shingle hashes of texts, in numpy alone: a word's hash is the difference of two prefix sums of its bytes."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.powers = [np.uint64(pow(_PRIME, k, 1 << 64)) for k in range(words)]
        self.up = self.down = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        """Powers of the base, and of its inverse, up to n."""
        if len(self.up) <= n:
            base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, base)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, inverse)]))

    def _hashes(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, begin) of the words of lower-case bytes."""
        inside = ~_SPACE[raw]
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        begin, end = edges[::2], edges[1::2]
        self._reach(len(raw))
        upto = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=upto[1:])
        value = (upto[end] - upto[begin]) * self.down[begin] + (end - begin).astype(np.uint64) * np.uint64(_PRIME)
        return _mix(value), begin

    def _words(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """_hashes() of pieces of bounded size, cut at white space."""
        hashes, begins, at = [], [], 0
        while at < len(raw):
            end = min(at + PIECE, len(raw))
            if end < len(raw):
                spaces = np.flatnonzero(_SPACE[raw[at:end]])
                after = np.flatnonzero(_SPACE[raw[end:]])[:1] if not len(spaces) else spaces[:0]
                end = at + int(spaces[-1]) + 1 if len(spaces) else end + int(after[0]) + 1 if len(after) else len(raw)
            h, b = self._hashes(raw[at:end])
            hashes.append(h)
            begins.append(b + at)
            at = end
        return (np.concatenate(hashes), np.concatenate(begins)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def sets(self, texts: list[bytes | None]) -> list[np.ndarray]:
        k = self.words
        joined = b" ".join([t or b"" for t in texts]).translate(LOWER)
        hashes, begins = self._words(np.frombuffer(joined, np.uint8))
        sizes = np.array([len(t or b"") + 1 for t in texts], np.int64)
        bounds = np.concatenate([[0], np.searchsorted(begins, np.cumsum(sizes))])
        rolled = np.zeros(0, np.uint64)
        if len(hashes) >= k:
            rolled = _mix(sum(hashes[j : len(hashes) - k + 1 + j] * self.powers[j] for j in range(k)))
        out = []
        for at, upto in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            n = upto - at
            if n >= k:
                out.append(np.unique(rolled[at : upto - k + 1]))
            elif n:
                out.append(_mix((hashes[at:upto] * np.array(self.powers[:n])).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def class_of(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    import xxhash

    value = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return value - (1 << 64) if value >> 63 else value


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (SIMILAR[0] * n + SIMILAR[1] - 1) // SIMILAR[1] + 1


def _texts(part: pa.RecordBatch, column: int, at_once: int = 1_500_000) -> Iterator[tuple[int, list[bytes | None]]]:
    """(index of the first row, texts) in runs of bounded size."""
    begin, held, size = 0, [], 0
    for i, value in enumerate(pc.cast(part.column(column), pa.binary())):
        raw = value.as_py()
        held.append(raw)
        size += len(raw or b"")
        if size >= at_once:
            yield begin, held
            begin, held, size = i + 1, [], 0
    if held:
        yield begin, held


def _key(shingles: np.ndarray, blocks: int) -> np.ndarray:
    """A shingle's block, from its high half, and its low half: what shingles are counted by."""
    return ((shingles >> np.uint64(32)) % np.uint64(blocks)) << np.uint64(32) | shingles & np.uint64(0xFFFFFFFF)


def _planes(sorted_halves: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as their differences, byte by byte, so that the high bytes, mostly zeros, compress."""
    steps = np.diff(sorted_halves, prepend=np.uint32(0)).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint32)


def _profile(words: int, blocks: int):
    """Each document's class and size, and the shingles of the classes of a task, packed by block."""
    names = ["doc_id", "cls", "n", "block", "packed"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Shingles(words)
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys = np.sort(_key(np.concatenate(held), blocks))
            held.clear()
            cuts = np.searchsorted(keys, np.arange(blocks + 1, dtype=np.uint64) << np.uint64(32))
            own = [i for i in range(blocks) if cuts[i + 1] > cuts[i]]
            packed = [_planes(keys[cuts[i] : cuts[i + 1]].astype(np.uint32)) for i in own]
            m = len(own)
            return pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(own, pa.int32()), pa.array(packed, pa.binary())], names)

        for part in parts:
            for begin, texts in _texts(part, 1):
                sets = maker.sets(texts)
                cls = [class_of(s) for s in sets]
                for c, s in zip(cls, sets, strict=True):
                    if c not in seen and len(s):
                        seen.add(c)
                        held.append(s)
                        size += len(s)
                if size > HELD:
                    yield flush()
                    size = 0
                n = len(texts)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(begin, n), pa.array(cls, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        if held:
            yield flush()

    return run


def _in_most(value: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """By falling counts, ties by value; which ones of a tie stay only changes speed."""
    if len(n) <= most:
        return value, n
    top = np.sort(np.argsort(-n, kind="stable")[:most])
    return value[top], n[top]


def _most_common(most: int, room: int = 0):
    """Of the packed shingles of each block of a task, sorted by block: those in most sets, `most` at most. With room, a row for
    each block that has them as lists, beside the bits that mark all in several sets, `room` at most, and whether they do mark all."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def found() -> pa.RecordBatch:
            value, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            value, n = value[n >= COMMON_SETS], n[n >= COMMON_SETS]
            if not room:
                value, n = _in_most(value, n, most)
                return pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64) | block << 32), pa.array(n.astype(np.int64))], ["key", "sets"])
            marked, _ = _in_most(value, n, room // CROWDED)
            width = -(-min(room, max(64, MARK_WIDTH * len(marked))) // 8) * 8
            bits = np.zeros(width, bool)
            bits[marked % np.uint32(width)] = True
            keys, sets = _in_most(value, n, most)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([len(marked) == len(value)]), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()), pa.array([(keys.astype(np.int64) | block << 32).tobytes()], pa.binary()), pa.array([sets.astype(np.int32).tobytes()], pa.binary())], ["block", "whole", "bits", "keys", "sets"])

        for part in parts:
            for b, raw in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                if held and b != block:
                    yield found()
                block = b
                held.append(_from_planes(raw.as_buffer()))
        if held:
            yield found()

    return run


class Common:
    """In how many sets a shingle is, as far as it is known: what _most_common(most, room) found in all blocks."""

    def __init__(self, found: pa.Table, blocks: int):
        rows = sorted(zip(*(found.column(c).to_pylist() for c in ("block", "whole", "bits", "keys", "sets")), strict=True), key=lambda r: r[0])
        self.blocks = blocks
        # Blocks without shingles have eight bits that mark none.
        self.whole, self.width = np.ones(blocks, bool), np.full(blocks, 8, np.uint64)
        raw = [b"\0"] * blocks
        for block, whole, bits, _, _ in rows:
            self.whole[block], self.width[block], raw[block] = whole, 8 * len(bits), bits
        self.first = np.cumsum(self.width) - self.width
        self.bits = np.frombuffer(b"".join(raw), np.uint8)
        # Blocks are the high half of keys, so the lists in their order are sorted.
        self.keys = np.frombuffer(b"".join([r[3] for r in rows]), np.uint64)
        self.sets = np.frombuffer(b"".join([r[4] for r in rows]), np.int32)

    def rank(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A rank in the common order, and which of them another set may have."""
        key = _key(shingles, self.blocks)
        block = (key >> np.uint64(32)).astype(np.int64)
        at = self.first[block] + (key & np.uint64(0xFFFFFFFF)) % self.width[block]
        marked = (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        rank = marked.astype(np.int32)
        if len(self.keys) and marked.any():
            own = key[marked]
            found = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
            rank[marked] = np.where(self.keys[found] == own, self.sets[found], 1)
        return rank, marked | ~self.whole[block]


def _postings(words: int, common: Common, blocks: int):
    """Packed prefix postings, by block: columns (hash) that other rows may have, rows (class), sizes."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Shingles(words)
        seen: set[int] = set()
        held: list[tuple[np.ndarray, int, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate([x for x, _, _ in held])
            lengths = [len(x) for x, _, _ in held]
            c = np.repeat(np.array([c for _, c, _ in held], np.int64), lengths)
            n = np.repeat(np.array([n for _, _, n in held], np.int32), lengths)
            block = (h >> np.uint64(33)).astype(np.int64) % blocks
            order = np.argsort(block, kind="stable")
            cuts = np.searchsorted(block[order], np.arange(blocks + 1))
            own = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            keep = [i for i, o in enumerate(own) if len(o)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array([h[own[i]].tobytes() for i in keep], pa.binary()), pa.array([c[own[i]].tobytes() for i in keep], pa.binary()), pa.array([n[own[i]].tobytes() for i in keep], pa.binary())], ["block", "h", "c", "n"])

        for part in parts:
            for _, texts in _texts(part, 0):
                for s in maker.sets(texts):
                    if not len(s) or (c := class_of(s)) in seen:
                        continue
                    seen.add(c)
                    n = len(s)
                    p = int(prefix_length(np.array(n)))
                    rank, shared = common.rank(s)
                    prefix = np.argsort(rank, kind="stable")[:p]
                    prefix = prefix[shared[prefix]]
                    if len(prefix):
                        held.append((s[prefix], c, n))
                        size += len(prefix)
                if size > 1_000_000:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _columns(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of a block that at least two rows share, as (col, row, n, lead) sorted by column and row; lead is a column's smallest row."""
    h, c, n = [], [], []
    for part in parts:
        h += [np.frombuffer(x, np.uint64) for x in part.column(1).to_pylist()]
        c += [np.frombuffer(x, np.int64) for x in part.column(2).to_pylist()]
        n += [np.frombuffer(x, np.int32) for x in part.column(3).to_pylist()]
    if not h:
        return
    h, c, n = np.concatenate(h), np.concatenate(c), np.concatenate(n)
    order = np.lexsort((c, h))
    h, c, n = h[order], c[order], n[order]
    fresh = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]  # tasks may share a class
    h, c, n = h[fresh], c[fresh], n[fresh]
    begins = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    sizes = np.diff(np.r_[begins, len(h)])
    many = np.repeat(sizes > 1, sizes)
    lead = np.repeat(c[begins], sizes)[many]
    h, c, n = h[many], c[many], n[many]
    for a in range(0, len(h), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(h[a : a + 100_000].view(np.int64)), pa.array(c[a : a + 100_000]), pa.array(n[a : a + 100_000].astype(np.int64)), pa.array(lead[a : a + 100_000])], ["col", "row", "n", "lead"])


def _accumulate(pairs: list[np.ndarray]) -> pa.RecordBatch:
    """Pairs (a, b, n_a, n_b as columns of an array) with the number of times each occurs."""
    all_pairs = np.concatenate(pairs, axis=1)
    order = np.lexsort((all_pairs[1], all_pairs[0]))
    p = all_pairs[:, order]
    begins = np.flatnonzero(np.r_[True, (p[0, 1:] != p[0, :-1]) | (p[1, 1:] != p[1, :-1])])
    counts = np.diff(np.r_[begins, p.shape[1]])
    return pa.RecordBatch.from_arrays([*(pa.array(p[i, begins]) for i in range(4)), pa.array(counts)], _PAIR)


def _needed(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Prefix shingles that two sets must share at least: the overlap their sizes ask for less the larger rest (see _bounded)."""
    t, u = SIMILAR
    return (t * (na + nb) + t + u - 1) // (t + u) - ((t * np.maximum(na, nb) + u - 1) // u - 1)


def _row_by_row(col: np.ndarray, row: np.ndarray, n: np.ndarray, root: np.ndarray, columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of rows of different components with the number of these columns, sorted by col, that they share; without those that
    can't share enough: beyond what they share here, only columns that lie elsewhere are left to both. As a pair that shares
    enough in all passes wherever it is met, the sums of such pairs stay whole."""
    begins = np.flatnonzero(np.r_[True, col[1:] != col[:-1]])
    sizes = np.diff(np.r_[begins, len(col)])
    rows, first, at = np.unique(row, return_index=True, return_inverse=True)
    n, root, columns = n[first], root[first], columns[first]
    elsewhere = columns - np.bincount(at)
    mixed = np.minimum.reduceat(root[at], begins) != np.maximum.reduceat(root[at], begins)
    if not mixed.any():
        return
    at, sizes = at[np.repeat(mixed, sizes)], sizes[mixed]
    starts = np.cumsum(sizes) - sizes
    number = np.repeat(np.arange(len(sizes)), sizes)
    by = np.argsort(at, kind="stable")
    own, cuts = np.unique(at[by], return_index=True)
    found: list[np.ndarray] = []
    held = 0
    for u, mine in zip(own.tolist(), np.split(number[by], cuts[1:]), strict=True):
        k = sizes[mine]
        v = at[np.repeat(starts[mine] - np.cumsum(k) + k, k) + np.arange(int(k.sum()))]
        v = v[v > u]
        if 8 * len(v) > len(rows):
            shared = np.bincount(v, minlength=len(rows))
            v = np.flatnonzero(shared)
            shared = shared[v]
        else:
            v, shared = np.unique(v, return_counts=True)
        few, many = np.minimum(n[v], n[u]), np.maximum(n[v], n[u])
        needed = _needed(n[v], n[u])
        keep = (root[v] != root[u]) & (SIMILAR[1] * few >= SIMILAR[0] * many) & (shared + np.minimum(elsewhere[v], elsewhere[u]) >= needed)
        v, shared = v[keep], shared[keep]
        if len(v):
            found.append(np.array([np.full(len(v), rows[u]), rows[v], np.full(len(v), n[u]), n[v], shared], np.int64))
            held += len(v)
        if held > 200_000:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, np.concatenate(found, axis=1))), _PAIR)
            found, held = [], 0
    if held:
        yield pa.RecordBatch.from_arrays(list(map(pa.array, np.concatenate(found, axis=1))), _PAIR)


def _product(star_round: int | None, at_once: int = 1_000_000):
    """Multiply the columns of a task: rows (col, row, n, root, shared columns of the row), the rows of a column side by side.

    star_round: each row with the leader of its column, as (row, leader). None: each pair of different components, at_once
    rows of whole columns at a time.
    """
    salt = np.uint64(0 if star_round is None else (2 * star_round + 1) * 0x9E3779B97F4A7C15 & _MASK)

    def whole_columns(parts: Iterator[pa.RecordBatch], least: int) -> Iterator[list[np.ndarray]]:
        held: list[pa.RecordBatch] = []
        size = 0
        for part in _with_end(parts):
            if part is not None:
                held.append(part)
                size += part.num_rows
            if not size or (part is not None and size < least):
                continue
            own = [np.concatenate([h.column(i).to_numpy(zero_copy_only=False) for h in held]) for i in range(held[0].num_columns)]
            # The last column may go on.
            cut = size if part is None else int(np.flatnonzero(np.r_[True, own[0][1:] != own[0][:-1]])[-1])
            held, size = [pa.RecordBatch.from_arrays([pa.array(x[cut:]) for x in own], held[0].schema.names)], size - cut
            if cut:
                yield [x[:cut] for x in own]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if star_round is None:
            for now in whole_columns(parts, at_once):
                yield from _row_by_row(*now)
            return
        pairs: list[np.ndarray] = []
        held = 0
        for now in whole_columns(parts, 1):
            begins = np.flatnonzero(np.r_[True, now[0][1:] != now[0][:-1]])
            sizes = np.diff(np.r_[begins, len(now[0])])
            draw = _mix(now[1].view(np.uint64) ^ salt)
            # What the copies of a group were made from shares most columns with others: copies have some of their own.
            order = np.lexsort((draw, *([-now[4]] if star_round == 0 else []), np.repeat(begins, sizes)))
            lead = np.repeat(order[begins], sizes)
            n, m = now[2], now[2][lead]
            hope = np.minimum(now[4], now[4][lead]) >= _needed(n, m)
            other = np.flatnonzero(hope & (now[3][lead] != now[3]) & (SIMILAR[1] * np.minimum(n, m) >= SIMILAR[0] * np.maximum(n, m)))
            pairs.append(np.array([now[1][other], now[1][lead[other]], n[other], m[other]], np.int64))
            held += len(other)
            if held > at_once:
                yield _accumulate(pairs)
                pairs, held = [], 0
        if held:
            yield _accumulate(pairs)

    return run


def _with_end(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    for part in parts:
        if part.num_rows:
            yield part
    yield None


def _bounded(products: DataFrame) -> DataFrame:
    """Pairs whose accumulated overlap can still reach the similarity that their sizes ask for.

    Of two prefixes one ends first in the common order. What its set shares up to there lies in both prefixes; the rest lies
    behind its own. As the blocks don't know which one that is, the larger rest counts.
    """
    t, u = SIMILAR
    rest = lambda n: F.expr(f"({t} * {n} + {u - 1}) div {u} - 1")  # noqa: E731  what lies behind the prefix
    need = F.expr(f"({t} * (na + nb) + {t + u - 1}) div {t + u}")
    sums = products.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("shared").alias("shared"))
    return sums.where((F.col("shared") + F.greatest(rest("na"), rest("nb")) >= need) & F.expr(f"{u} * least(na, nb) >= {t} * greatest(na, nb)"))


def _members(words: int, bits: np.ndarray):
    """Sets of the classes that the filter passes, once in a task."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Shingles(words)
        seen: set[int] = set()
        for part in parts:
            for _, texts in _texts(part, 0):
                cls, sets = [], []
                for s in maker.sets(texts):
                    if not len(s):
                        continue
                    c = class_of(s)
                    at = (c & _MASK) % FILTER_BITS
                    if bits[at >> 3] >> (at & 7) & 1 and c not in seen:
                        seen.add(c)
                        cls.append(c)
                        sets.append(s.tobytes())
                if cls:
                    yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(sets, pa.binary())], ["cls", "members"])

    return run


def _verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t, u = SIMILAR
    for part in parts:
        keep = []
        for i, (x, y) in enumerate(zip(part.column(2), part.column(3), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            same = int((y[at] == x).sum())
            if u * same >= t * (len(x) + len(y) - same):
                keep.append(i)
        take = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take)], ["a", "b"])


def _filter_of(classes: DataFrame) -> np.ndarray:
    """The fixed-size filter of a column `c` of classes, 32 bits to a word; FILTER_BITS in all at most."""
    # The same position as in _members: the unsigned value modulo a power of two is the low bits of the signed one.
    at = F.col("c").bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = classes.select(at.alias("at")).groupBy(F.shiftright("at", 5).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(31)).cast("int"))).alias("b"))
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    found = rows.toArrow()
    out[found.column("w").to_numpy()] = found.column("b").to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def _wanted(bits: np.ndarray):
    """Sets of the classes that the filter passes, so that others aren't shuffled."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at = part.column(0).to_numpy() & (FILTER_BITS - 1)
            yield part.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

    return run


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the written pairs (a, b) whose whole sets are similar enough."""
    bits = pairs.sparkSession.sparkContext.broadcast(_filter_of(pairs.select(F.explode(F.array("a", "b")).alias("c"))))
    run = lambda parts: _wanted(bits.value)(parts)
    some = sets.mapInArrow(run, "cls long, members binary")
    both = pairs.select("a", "b").join(some.select(F.col("cls").alias("a"), F.col("members").alias("x")), "a").join(some.select(F.col("cls").alias("b"), F.col("members").alias("y")), "b")
    return materialize(both.select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long"), "links")


def link_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs.

    Null and empty texts have no set, size 0, and are components of their own; a text of fewer words than a shingle is one
    shingle. Repeated rows stay and share a component. A null id counts as larger than all others: it names a component
    only where no other id does. Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    texts = rows.select("text")
    # As many blocks as the corpus has splits, so that a block's size doesn't grow with the corpus.
    blocks = max(shuffle_width(spark), rows.rdd.getNumPartitions())
    profile = materialize(rows.mapInArrow(_profile(words, blocks), "doc_id long, cls long, n long, block int, packed binary"), "profile")
    dealt = profile.where("packed is not null").select("block", "packed").repartitionById(blocks, "block").sortWithinPartitions("block")
    counted = materialize(dealt.mapInArrow(_most_common(max(1, COMMON // blocks), max(64, MARK_BITS // blocks)), "block int, whole boolean, bits binary, keys binary, sets binary"), "common")
    shipped = spark.sparkContext.broadcast(Common(counted.toArrow(), blocks))
    mine = materialize(profile.where("cls is not null").select("doc_id", "cls", "n"), "classes")
    drop(spark, profile, counted)
    deal = lambda parts: _postings(words, shipped.value, blocks)(parts)
    packed = texts.mapInArrow(deal, "block int, h binary, c binary, n binary").repartitionById(blocks, "block")
    raw = materialize(packed.mapInArrow(_columns, "col long, row long, n long, lead long"), "columns")
    spread = raw.groupBy("row").agg(F.count(F.lit(1)).alias("columns"))
    columns = materialize(raw.join(spread, "row").select("col", "row", "n", "columns", "lead"), "columns")
    drop(spark, raw)
    bits = spark.sparkContext.broadcast(_filter_of(columns.select(F.col("row").alias("c")).distinct()))
    members = lambda parts: _members(words, bits.value)(parts)
    # A class can come from several tasks; its set is the same in all.
    sets = materialize(texts.mapInArrow(members, "cls long, members binary").groupBy("cls").agg(F.first("members").alias("members")), "sets")

    product = "a long, b long, na long, nb long, shared long"
    roots = spark.createDataFrame([], "node long, root long")

    def multiplied(star_round: int | None) -> DataFrame:
        labelled = columns.join(roots.withColumnRenamed("node", "row"), "row", "left").select("col", "row", "n", F.coalesce("root", "row").alias("root"), "columns", "lead")
        # Columns that share documents mostly share their smallest one: together in a block, they make a pair once, not once in each block.
        dealt = labelled.repartition(blocks, "lead").sortWithinPartitions("lead", "col")
        return dealt.drop("lead").mapInArrow(_product(star_round), product)

    def joined(more: DataFrame) -> DataFrame:
        return materialize(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "roots")

    for star_round in range(STAR_ROUNDS):
        sums = multiplied(star_round).groupBy("a", "b").agg(F.sum("shared").alias("shared"))
        best = sums.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))
        roots = joined(_links(materialize(best, "pairs"), sets))
    roots = joined(_links(materialize(_bounded(multiplied(None)), "pairs"), sets))
    drop(spark, sets, columns)

    least = mine.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("d"))
    named = least.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"), "d")
    groups = named.join(named.groupBy("root").agg(F.min("d").alias("component_id")), "root").select("cls", "component_id")
    linked = mine.join(groups, "cls", "left")
    return linked.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, in their own columns, with one row of each group: the one with the smallest id.

    Of rows with that id and one text, the one with the smallest hash of all columns stays. A null id comes last. Rows without
    words (null, empty, white space) are no copies, and all stay.
    """
    key, mark = fresh("key", docs.columns), fresh("mark", docs.columns)
    own = docs.withColumn(key, F.xxhash64(id_col, text))
    rows = own.groupBy(F.col(key).alias("doc_id")).agg(F.min(id_col).alias("id"), F.count(F.lit(1)).alias("n"))
    named = link_groups(own, key, text).where("n_shingles > 0").select("doc_id", "component_id").distinct().join(rows, "doc_id")
    best = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "doc_id")).alias("best"))
    marks = named.join(best, "component_id").select(F.col("doc_id").alias(key), F.when(F.col("doc_id") != F.col("best.doc_id"), "goes").when(F.col("n") > 1, "repeats").alias(mark))
    joined = own.join(marks.where(F.col(mark).isNotNull()), key, "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # Repeats of a row meet in an aggregate that combines before the shuffle.
    one = joined.where(F.col(mark) == "repeats").groupBy(key).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row"))
    return joined.where(F.col(mark).isNull()).select(*columns).unionByName(one.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by the similarity of their sets of five-word shingles.
    Nulls, empty and long texts, repeated rows and empty tables as in link_groups: a row for every row of documents."""
    return link_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
