"""Language-model scoring by prediction by partial matching over bytes, beside a word-unigram score.

A text, A-Z lower-cased, is its UTF-8 bytes and one end symbol; END (256) also stands for what precedes a text. The model is
a trie of byte contexts up to ORDER symbols long, with counts from all training texts; every node is kept. A symbol is coded
in the longest context that the trie has. Escape estimation is method C; after an escape the symbols of the longer context
are excluded from the shorter one (they form nested sets, so the exclusion at an order depends on one context only). Below
order 0, symbols not excluded are equally likely. The model is a proper distribution: over all symbols a context gives
probabilities that sum to 1. Training is complete before scoring (`pretrained`), so the score of a text depends on no other
text that is scored.

The trie isn't held in one place. What a symbol's probability depends on shares the last SUFFIX symbols of its context, so
the codes of the highest order are dealt by these, and a task works out the log probability of each of its codes from its
part of the trie and the nodes of the lowest orders, of which there are at most 257 ** SUFFIX. A text's score is the sum over its codes.

Words: maximal runs of bytes other than space and 0x09-0x0D, and one end token for each text. Their counts stay a table.
At most NODES codes and HEAVY words, the most frequent ones, are shipped to the tasks with their values; all others are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import LOWER, fold_of, materialize, shuffle_width, table

END = 256
BITS = 9
ORDER = 5
#: Codes are dealt by the symbols just before the last one: so many of them.
SUFFIX = 2
#: Codes of which a task works out the values at once, at the end of a suffix.
AT_ONCE = 500_000
#: The most frequent codes and words, so many at most, are looked up in the tasks; others are joined.
NODES = 1 << 20
HEAVY = 1 << 19
_HASH = np.uint64(0x9E3779B97F4A7C15)


def codes_of(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(for each symbol of each text its code: the `order` symbols before it and itself, BITS each; symbols of each text)."""
    lengths = np.array([len(t) for t in texts], np.int64)
    # Each text is preceded by `order` END symbols and followed by one.
    size = lengths + order + 1
    starts = np.cumsum(size) - size
    flat = np.full(int(size.sum()), END, np.uint64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    flat[np.repeat(starts + order - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(raw))] = raw
    code = flat[: len(flat) - order].copy()
    for k in range(1, order + 1):
        code <<= np.uint64(BITS)
        code |= flat[k : len(flat) - order + k]
    counted = lengths + 1
    at = np.repeat(starts - (np.cumsum(counted) - counted), counted) + np.arange(int(counted.sum()))
    return code[at], counted


class Table:
    """Positions of 64-bit codes: sorted by a hash, found through the hash's leading bits."""

    def __init__(self, codes: np.ndarray):
        self.bits = max(8, int(len(codes)).bit_length() + 1)
        bucket = self._bucket(codes)
        order = np.argsort(bucket, kind="stable")
        self.codes = np.append(codes[order], np.uint64((1 << 64) - 1))
        self.place = np.append(order, -1).astype(np.int32)
        self.first = np.searchsorted(bucket[order], np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.most = int(np.diff(self.first).max()) if len(codes) else 0

    def _bucket(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * _HASH) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Index in the codes given at first, or -1."""
        b = self._bucket(codes)
        at, end = self.first[b], self.first[b + 1]
        out = np.full(len(codes), -1, np.int64)
        left = np.flatnonzero(at < end)
        for step in range(self.most):
            here = at[left] + step
            hit = self.codes[here] == codes[left]
            out[left[hit]] = self.place[here[hit]]
            left = left[~hit & (here + 1 < end[left])]
            if not len(left):
                break
        return out


class Model:
    """The trie as arrays. For each order o: codes of kept nodes (context and symbol) with counts, and for each kept context
    its total. Log10 probabilities are worked out once; scoring only looks them up."""

    def __init__(self, order: int, nodes: list[tuple[np.ndarray, np.ndarray]], totals: list[tuple[np.ndarray, np.ndarray]]):
        self.order = order
        self.nodes = [Table(c) for c, _ in nodes]
        self.contexts = [Table(c) for c, _ in totals]
        self.count = [np.log10(np.maximum(n, 1)) for _, n in nodes]
        kept, distinct = [], []
        for o in range(order + 1):
            at = self.contexts[o].find(nodes[o][0] >> np.uint64(BITS)) if len(nodes[o][0]) else np.zeros(0, np.int64)
            kept.append(np.bincount(at, nodes[o][1], minlength=len(totals[o][0])))
            distinct.append(np.bincount(at, minlength=len(totals[o][0])).astype(np.float64))
        #: As the longest context: log10 of what counts are divided by, and of the probability to escape.
        self.whole = [np.log10(t + d) for (_, t), d in zip(totals, distinct, strict=True)]
        with np.errstate(divide="ignore"):
            self.escape = [np.log10(np.maximum(t - k + d, 0) / (t + d)) for (_, t), k, d in zip(totals, kept, distinct, strict=True)]
        #: For a context of order o > 0, the same in its suffix when its own symbols are excluded there.
        self.parent, self.part, self.pass_on = [None], [None], [None]
        for o in range(1, order + 1):
            codes, n = nodes[o]
            own = self.contexts[o].find(codes >> np.uint64(BITS)) if len(codes) else np.zeros(0, np.int64)
            below = self.nodes[o - 1].find(codes & np.uint64((1 << BITS * o) - 1)) if len(codes) else np.zeros(0, np.int64)
            shared = np.bincount(own, nodes[o - 1][1][below] if len(codes) else None, minlength=len(totals[o][0]))
            suffix = totals[o][0] & np.uint64((1 << BITS * (o - 1)) - 1)
            up = self.contexts[o - 1].find(suffix) if len(suffix) else np.zeros(0, np.int64)
            t, k, d = totals[o - 1][1][up] - shared, kept[o - 1][up] - shared, distinct[o - 1][up] - distinct[o]
            self.parent.append(up)
            with np.errstate(divide="ignore", invalid="ignore"):
                self.part.append(np.log10(np.maximum(t + d, 1e-9)))
                leave = np.where(t + d > 0, (np.maximum(t - k, 0) + d) / np.maximum(t + d, 1e-9), 1.0)
                self.pass_on.append(np.log10(np.where(leave > 0, leave, 1.0)))
        self.rest = np.log10(np.maximum(1, END + 1 - (distinct[0] if len(distinct[0]) else np.zeros(1))))

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """The log10 probability of the last symbol of each code given the symbols before it."""
        out = np.zeros(len(codes))
        todo = np.arange(len(codes))
        came = np.full(len(codes), -1, np.int64)  # the context of the next higher order that was escaped from
        for o in range(self.order, -1, -1):
            c = codes[todo] & np.uint64((1 << BITS * (o + 1)) - 1)
            at = self.nodes[o].find(c)
            hit = at >= 0
            prior = came[todo]
            first = prior < 0
            got = todo[hit & first]
            out[got] += self.count[o][at[hit & first]] - self.whole[o][self.contexts[o].find(c[hit & first] >> np.uint64(BITS))]
            if o < self.order:
                later = hit & ~first
                out[todo[later]] += self.count[o][at[later]] - self.part[o + 1][prior[later]]
            miss = ~hit
            left, prior = todo[miss], prior[miss]
            if o < self.order:
                escaped = prior >= 0
                out[left[escaped]] += self.pass_on[o + 1][prior[escaped]]
                came[left[escaped]] = self.parent[o + 1][prior[escaped]]
            else:
                escaped = np.zeros(len(left), bool)
            fresh = left[~escaped]
            own = self.contexts[o].find(c[miss][~escaped] >> np.uint64(BITS))
            known = own >= 0
            out[fresh[known]] += self.escape[o][own[known]]
            came[fresh[known]] = own[known]
            todo = left
            if not len(todo):
                return out
        # Not even order 0 has the symbol: all symbols that it lacks are equally likely.
        out[todo] -= self.rest[0] if len(self.rest) else np.log10(END + 1)
        return out


def _lower(value) -> bytes:
    raw = value.as_py()
    return raw.translate(LOWER) if raw else b""


def _runs(column: pa.Array, size: int = 2_000_000) -> Iterator[tuple[int, list[bytes]]]:
    begin, held, n = 0, [], 0
    for i, value in enumerate(pc.cast(column, pa.binary())):
        held.append(_lower(value))
        n += len(held[-1])
        if n >= size:
            yield begin, held
            begin, held, n = i + 1, [], 0
    if held:
        yield begin, held


def _hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _gather(order: int, blocks: int):
    """Counts of a task, packed by block (training, all): kind 0 words, kind 1 codes of the highest order."""
    names = ["block", "kind", "keys", "train", "every"]

    def packed(kind: int, keys: np.ndarray, train: np.ndarray, every: np.ndarray) -> pa.RecordBatch:
        block = ((keys * _HASH) >> np.uint64(33)).astype(np.int64) % blocks
        by = np.argsort(block, kind="stable")
        cuts = np.searchsorted(block[by], np.arange(blocks + 1))
        own = [(i, by[a:b]) for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
        small = lambda x: [x[o].astype(np.uint32).tobytes() for _, o in own]
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int32()), pa.array([kind] * len(own), pa.int32()), pa.array([keys[o].tobytes() for _, o in own], pa.binary()), pa.array(small(train), pa.binary()), pa.array(small(every), pa.binary())], names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter[bytes] = Counter()
        other: Counter[bytes] = Counter()
        grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def words() -> pa.RecordBatch:
            every = list(train.keys() | other.keys())
            a = np.fromiter(map(train.__getitem__, every), np.int64, len(every))
            out = packed(0, _hashes(every), a, a + np.fromiter(map(other.__getitem__, every), np.int64, len(every)))
            train.clear()
            other.clear()
            return out

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            keys = np.concatenate([g[0] for g in grams])
            by = np.argsort(keys, kind="stable")
            keys = keys[by]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            a, b = (np.add.reduceat(np.concatenate([g[j] for g in grams])[by], first) for j in (1, 2))
            return keys[first], a, b

        for part in parts:
            held_out = part.column(0).to_numpy(zero_copy_only=False)
            for begin, texts in _runs(part.column(1)):
                learn, rest = [], []
                for i, text in enumerate(texts):
                    (other if held_out[begin + i] else train).update(text.split())
                    (rest if held_out[begin + i] else learn).append(text)
                for own, learnt in ((learn, 1), (rest, 0)):
                    if own:
                        keys, n = np.unique(codes_of(own, order)[0], return_counts=True)
                        grams.append((keys, n * learnt, n))
                        held += len(keys)
                if held > 3_000_000:
                    grams[:] = [merged()]
                    held = len(grams[0][0])
                    if held > 2_000_000:
                        yield packed(1, *grams.pop())
                        held = 0
                if len(train) + len(other) > 500_000:
                    yield words()
        if train or other:
            yield words()
        if grams:
            yield packed(1, *merged())

    return run


def _add_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a block over all tasks."""
    found: dict[int, list] = {0: [], 1: []}
    for part in parts:
        for _, kind, keys, train, every in zip(*[c.to_pylist() for c in part.columns], strict=True):
            found[kind].append((np.frombuffer(keys, np.uint64), np.frombuffer(train, np.uint32), np.frombuffer(every, np.uint32)))
    for kind, all_parts in found.items():
        if not all_parts:
            continue
        keys = np.concatenate([k for k, _, _ in all_parts])
        by = np.argsort(keys, kind="stable")
        keys = keys[by]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sums = [np.add.reduceat(np.concatenate([p[j] for p in all_parts]).astype(np.int64)[by], first) for j in (1, 2)]
        keys = keys[first]
        for a in range(0, len(keys), 200_000):
            b = slice(a, a + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[b]), kind, np.int32)), pa.array(keys[b].view(np.int64)), pa.array(sums[0][b]), pa.array(sums[1][b])], ["kind", "key", "train", "every"])


def gather_counts(docs: DataFrame, held_out: Column, text: str = "text", order: int = ORDER) -> DataFrame:
    """(kind, key, train, every): counts of word hashes (0) and of byte codes of the highest order (1), written."""
    blocks = shuffle_width(docs.sparkSession)
    packed = docs.select(held_out.alias("held_out"), F.col(text).alias("text")).mapInArrow(_gather(order, blocks), "block int, kind int, keys binary, train binary, every binary")
    return materialize(packed.repartitionById(blocks, "block").mapInArrow(_add_up, "kind int, key long, train long, every long"), "lm-counts")


def _summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(codes, return_inverse=True)
    return keys, np.bincount(at, n, minlength=len(keys))


def _values(order: int, low: tuple[np.ndarray, np.ndarray]):
    """The log10 probability of each code. Rows: suffix, key, train, every, in the order of suffix, all of a suffix in one task.
    `low` are all nodes of the highest order below SUFFIX."""
    level = min(order, SUFFIX - 1)

    def worked_out(codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        learnt = n > 0
        nodes, totals = [], []
        for o in range(order + 1):
            source = low if o <= level else (codes[learnt], n[learnt])
            nodes.append(_summed(source[0] & np.uint64((1 << BITS * (o + 1)) - 1), source[1]))
            totals.append(_summed(nodes[-1][0] >> np.uint64(BITS), nodes[-1][1]))
        return Model(order, nodes, totals).log10(codes)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            codes, n = (np.concatenate([h.column(j).to_numpy() for h in held]) for j in (1, 2))
            every = np.concatenate([h.column(3).to_numpy() for h in held])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(every), pa.array(worked_out(codes.view(np.uint64), n.astype(np.float64)))], ["key", "every", "value"])

        for part in parts:
            if not part.num_rows:
                continue
            if sum(h.num_rows for h in held) >= AT_ONCE:
                # All that ended before this batch's last suffix, which may go on, or began.
                suffix = part.column(0).to_numpy()
                cut = 0 if suffix[0] != held[-1].column(0)[-1].as_py() else int(np.searchsorted(suffix, suffix[0], "right"))
                if cut < len(suffix):
                    held.append(part.slice(0, cut))
                    yield out()
                    part = part.slice(cut)
            held.append(part)
        if held:
            yield out()

    return run


def code_values(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, every, value): each code of gather_counts with its log10 probability in the whole trie, written."""
    codes = counts.where("kind = 1")
    part = lambda bits: F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    low = codes.groupBy(part(BITS * min(order + 1, SUFFIX)).alias("key")).agg(F.sum("train").alias("n")).where("n > 0").toArrow()
    shipped = counts.sparkSession.sparkContext.broadcast((low.column("key").to_numpy().view(np.uint64), low.column("n").to_numpy().astype(np.float64)))
    run = lambda parts: _values(order, shipped.value)(parts)
    dealt = codes.select(F.shiftright(part(BITS * (SUFFIX + 1)), BITS).alias("suffix"), "key", "train", "every").repartition("suffix").sortWithinPartitions("suffix")
    return materialize(dealt.mapInArrow(run, "key long, every long, value double"), "lm-values")


def _most_frequent(table_: DataFrame, most: int) -> DataFrame:
    """The rows with the largest `every`, at most so many: those from the least step of a finely graded scale on that has no more."""
    step = F.floor(F.log2("every") * 16)
    sizes = table_.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect()
    least, held = None, 0
    for r in sizes:
        held += r["n"]
        if held > most:
            break
        least = r["step"]
    return table_.where(step >= least) if least is not None else table_.limit(0)


def _scorer(codes_and_values: tuple[np.ndarray, np.ndarray], heavy: np.ndarray, heavy_count: np.ndarray, order: int):
    """Rows: row, doc_id, held_out, n_tokens, n_known, part (sum of log10(c + 0.5)), score, kind and key.

    A rare word (kind 0) or code (1) is a row of its own; a document's row (2) carries a hash of its number, to be dealt evenly.
    """
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "part", "score", "kind", "key"]
    known_codes, values = Table(codes_and_values[0]), np.append(codes_and_values[1], 0.0)

    def rare(kind: int, row: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        m = len(row)
        return pa.RecordBatch.from_arrays([pa.array(row), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()), pa.array(np.full(m, kind, np.int32)), pa.array(keys.view(np.int64))], names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        hashes, slots = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int64)
        logs = np.log10(heavy_count + 0.5) if len(heavy) else np.zeros(0)
        for part in parts:
            rows = part.column(0).to_numpy()
            for begin, texts in _runs(part.column(3)):
                k = len(texts)
                row = rows[begin : begin + k]
                codes, lengths = codes_of(texts, order)
                found = known_codes.find(codes)
                # What isn't found has the last place, a zero.
                score = np.add.reduceat(values[found], np.cumsum(lengths) - lengths)
                lost = np.flatnonzero(found < 0)
                if len(lost):
                    yield rare(1, row[np.searchsorted(np.cumsum(lengths), lost, "right")], codes[lost])
                words, sizes = [], []
                for t in texts:
                    own = t.split()
                    words += own
                    sizes.append(len(own))
                if len(memo) > 500_000:
                    memo.clear()
                at = np.fromiter((memo.get(w, -1) for w in words), np.int64, len(words))
                if (new := np.flatnonzero(at < 0)).size:
                    fresh = list(dict.fromkeys(words[i] for i in new.tolist()))
                    base = len(memo)
                    memo.update(zip(fresh, range(base, base + len(fresh)), strict=True))
                    if base + len(fresh) > len(hashes):
                        hashes, slots = np.resize(hashes, 2 * (base + len(fresh))), np.resize(slots, 2 * (base + len(fresh)))
                    h = _hashes(fresh)
                    hashes[base : base + len(fresh)] = h
                    if len(heavy):
                        place = np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)
                        slots[base : base + len(fresh)] = np.where(heavy[place] == h, place, -1)
                    else:
                        slots[base : base + len(fresh)] = -1
                    at[new] = [memo[words[i]] for i in new.tolist()]
                owner = np.repeat(np.arange(k), sizes)
                slot = slots[at]
                common = slot >= 0
                part_sum = np.bincount(owner[common], logs[slot[common]], minlength=k).astype(np.float64)
                known = np.bincount(owner[common], heavy_count[slot[common]] > 0, minlength=k).astype(np.int64)
                spread = ((row.astype(np.uint64) + np.uint64(1)) * _HASH).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(row), part.column(1).slice(begin, k), part.column(2).slice(begin, k), pa.array(np.array(sizes, np.int64) + 1), pa.array(known), pa.array(part_sum), pa.array(score), pa.array(np.full(k, 2, np.int32)), pa.array(spread)], names)
                if not common.all():
                    yield rare(0, row[owner[~common]], hashes[at[~common]])

    return run


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text: str = "text", order: int = ORDER, nodes: int = NODES, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row; rows with held_out aren't learnt from.

    Null texts count as empty: one token, the end. Repeated rows each count. Without training rows, base_score is log10(0.5 /
    0.5) for each token and every symbol of the model has probability 1/257. `nodes` and `heavy` say how many codes and words
    are looked up in the tasks instead of by a join; they change no result.
    """
    spark = docs.sparkSession
    counts = gather_counts(docs, held_out, text, order)
    ends = docs.agg(F.count(F.lit(1)).alias("every"), F.coalesce(F.sum((~held_out).cast("long")), F.lit(0)).alias("train")).first()
    words = counts.where("kind = 0")
    sums = words.agg(F.coalesce(F.sum("train"), F.lit(0)).alias("n"), F.count_if(F.col("train") > 0).alias("v")).first()
    n, v = sums["n"] + ends["train"], sums["v"] + (1 if ends["train"] else 0)
    most = _most_frequent(words, heavy).select("key", "train").toArrow()
    keys = most.column("key").to_numpy().view(np.uint64)
    by = np.argsort(keys)
    values = code_values(counts, order)
    top = _most_frequent(values, nodes).select("key", "value").toArrow()
    shipped = spark.sparkContext.broadcast(((top.column("key").to_numpy().view(np.uint64), top.column("value").to_numpy()), keys[by], most.column("train").to_numpy()[by].astype(np.float64)))
    run = lambda parts: _scorer(*shipped.value, order)(parts)
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, part double, score double, kind int, key long"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text")).mapInArrow(run, schema)
    learnt = words.select("kind", "key", F.col("train").alias("c"), F.lit(None).cast("double").alias("value")).unionByName(values.select(F.lit(1).alias("kind"), "key", F.lit(0).cast("long").alias("c"), "value"))
    joined = rows.join(learnt, ["kind", "key"], "left")
    c = F.coalesce("c", F.lit(0))
    end_log = F.lit(float(np.log10(ends["train"] + 0.5)))
    known = F.when(F.col("kind") == 2, F.col("n_known") + (1 if ends["train"] else 0)).when(F.col("kind") == 0, (c > 0).cast("long"))
    logs = F.when(F.col("kind") == 2, F.col("part") + end_log).when(F.col("kind") == 0, F.log10(c + 0.5))
    first = lambda name: F.max(name).alias(name)
    sums = joined.groupBy("row").agg(first("doc_id"), first("held_out"), first("n_tokens"), F.sum(known).alias("n_known"), F.sum(logs).alias("logs"), F.sum(F.coalesce("score", "value")).alias("score"))
    below = float(np.log10(n + 0.5 * (v + 1)))
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * below).alias("base_score"), "score")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents scored by the model of four fifths of them.
    Nulls, empty and long texts, repeated rows and empty tables as in score_texts: a row for every row of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, fold_of(F.col("doc_id")) == 1)
