"""Hard negatives by a two-dimensional block product of anchors and rows (SUMMA-style), in whole numbers.

Rows and anchors are dealt to blocks of about BLOCK rows, and each block's integer matrix is cut into chunks of dimensions.
Every (block of anchors, block of rows, chunk) is one product in a task of its own; its tile of 64-bit scores is shuffled to
the (block of anchors, block of rows) it belongs to and added up there, chunk by chunk. A whole tile is at once reduced to
the few best rows of each window, and those are merged in groups of FAN tiles until one is left for a block of anchors. So a
task never holds more than two blocks, the chunks of one tile, or FAN reduced tiles, whatever the number of rows.

It runs twice. The first product meets only blocks whose labels fall into the same of LABELS buckets, and gives the
positives; they make the windows of the second, in which every block of anchors meets every block of rows. The work grows
with anchors times rows, as a stated query set against all rows must.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import fresh, materialize, table

BLOCK, CHUNK, MAX_CHUNKS, LABELS, FAN = 1024, 32, 8, 16, 32
#: The score of a place that no row holds; no score is as small.
NONE = -(2**63 - 1)
_BLOCK = "anchor boolean, block int, bucket int, chunk int, ids binary, labels binary, windows binary, matrix binary"
_TILE = "i int, j int, chunk int, ids binary, labels binary, windows binary, row_ids binary, row_labels binary, width int, scores binary"
_BEST = "i int, j int, ids binary, scores binary"


def ints(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def top(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line of scores the k best columns allowed, ties to the smaller id: their ids and scores, NONE where there are fewer. ids rise."""
    n, m = scores.shape
    masked = np.where(allowed, scores, NONE)
    if m > k:
        limit = np.partition(masked, m - k, axis=1)[:, m - k, None]
        line, column = np.nonzero((masked >= limit) & (masked > NONE))
    else:
        line, column = np.nonzero(masked > NONE)
    worth = masked[line, column]
    order = np.lexsort((column, -worth, line))
    line, column, worth = line[order], column[order], worth[order]
    place = np.arange(len(line)) - np.searchsorted(line, line)
    kept = place < k
    best_ids, best = np.zeros((n, k), np.int64), np.full((n, k), NONE, np.int64)
    best_ids[line[kept], place[kept]], best[line[kept], place[kept]] = ids[column[kept]], worth[kept]
    return best_ids, best


def merged(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each line over the last axis, ties to the smaller id."""
    order = np.lexsort((ids, -scores), axis=-1)[..., :k]
    return np.take_along_axis(ids, order, -1), np.take_along_axis(scores, order, -1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed in 64-bit integers; through doubles where no partial sum can leave the range they hold exactly."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def narrow(scores: np.ndarray) -> tuple[int, bytes]:
    """The scores in the narrowest whole numbers that hold them, and their width in bytes."""
    most = int(np.abs(scores).max(initial=0))
    width = next(w for w in (2, 4, 8) if most < 2 ** (8 * w - 1))
    return width, scores.astype(f"<i{width}").tobytes()


def _pack(chunk: int, chunks: int):
    """One row for each chunk of dimensions of a block: its ids, labels and integer matrix. Rows in the order of ids."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        anchor, block, bucket = (x.as_py() for x in key)
        ids = rows.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        vectors = rows.column("vec").combine_chunks()
        matrix = np.zeros((len(ids), chunk * chunks))
        lengths = np.diff(vectors.offsets.to_numpy())
        line = np.repeat(np.arange(len(ids)), lengths)
        matrix[line, np.arange(len(line)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = vectors.flatten().to_numpy()
        whole = np.floor(256 * matrix[order]).astype(np.int64)
        labels = rows.column("label").to_numpy()[order]
        names = [f.split()[0] for f in _BLOCK.split(", ")]
        out = [
            (anchor, block, bucket, c, ids[order].tobytes() if c == 0 else b"", labels.tobytes() if c == 0 else b"", b"", np.ascontiguousarray(whole[:, c * chunk : (c + 1) * chunk]).tobytes())
            for c in range(chunks)
        ]
        return pa.Table.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=_arrow(_BLOCK))

    return run


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in ddl.split(", "))])


def _multiply(chunk: int):
    """The tile of partial scores of one block of anchors, one block of rows and one chunk."""

    def run(key: tuple[pa.Scalar, ...], both: pa.Table) -> pa.Table:
        sides = {x["anchor"]: x for x in both.to_pylist()}
        if len(sides) < 2:
            return _arrow(_TILE).empty_table()
        a, b = sides[True], sides[False]
        width, scores = narrow(product(ints(a["matrix"]).reshape(-1, chunk), ints(b["matrix"]).reshape(-1, chunk)))
        i, j, c = (x.as_py() for x in key)
        tile = {"i": i, "j": j, "chunk": c, "ids": a["ids"], "labels": a["labels"], "windows": a["windows"], "row_ids": b["ids"], "row_labels": b["labels"], "width": width, "scores": scores}
        return pa.Table.from_pylist([tile], schema=_arrow(_TILE))

    return run


def _add(choose):
    """The sum of a tile's chunks, reduced by choose(scores, head) to ids and scores of the best."""

    def run(key: tuple[pa.Scalar, ...], tiles: pa.Table) -> pa.Table:
        total, head = 0, None
        for batch in tiles.to_batches(max_chunksize=1):
            tile = batch.to_pylist()[0]
            total = total + np.frombuffer(tile["scores"], f"<i{tile['width']}").astype(np.int64)
            if tile["chunk"] == 0:
                head = tile
        ids, scores = choose(total.reshape(len(head["ids"]) // 8, -1), head)
        i, j = (x.as_py() for x in key)
        return pa.Table.from_pylist([{"i": i, "j": j, "ids": ids.tobytes(), "scores": scores.tobytes()}], schema=_arrow(_BEST))

    return run


def _merge(k: int):
    def run(key: tuple[pa.Scalar, ...], tiles: pa.Table) -> pa.Table:
        ids = [ints(x).reshape(-1, k) for x in tiles.column("ids").to_pylist()]
        scores = [ints(x).reshape(-1, k) for x in tiles.column("scores").to_pylist()]
        best = merged(np.concatenate(ids, axis=1), np.concatenate(scores, axis=1), k)
        i, j = (x.as_py() for x in key)
        return pa.Table.from_pylist([{"i": i, "j": j, "ids": best[0].tobytes(), "scores": best[1].tobytes()}], schema=_arrow(_BEST))

    return run


def _positives(k: int):
    def choose(scores: np.ndarray, head: dict) -> tuple[np.ndarray, np.ndarray]:
        ids = ints(head["row_ids"])
        same = (ints(head["labels"])[:, None] == ints(head["row_labels"])[None, :]) & (ints(head["ids"])[:, None] != ids[None, :])
        return top(scores, same, ids, k)

    return choose


def _negatives(positives: int, k: int, share: tuple[int, int]):
    """share: (a, b) for the lower end of a window, a / b of the positive's score."""

    def choose(scores: np.ndarray, head: dict) -> tuple[np.ndarray, np.ndarray]:
        ids, windows = ints(head["row_ids"]), ints(head["windows"]).reshape(-1, positives)
        other = ints(head["labels"])[:, None] != ints(head["row_labels"])[None, :]
        found = []
        for w in range(positives):
            high = windows[:, w, None]
            # Rounded up in Python's integers, which don't overflow. A place without a positive gets an empty window.
            low = np.array([1 if p == NONE else -((-share[0] * int(p)) // share[1]) for p in windows[:, w]], np.int64)[:, None]
            found.append(top(scores, other & (scores >= low) & (scores <= high), ids, k))
        return tuple(np.stack(x, axis=1).reshape(-1, k) for x in zip(*found, strict=True))

    return choose


def _rows(positives: int, k: int):
    """The result's rows of one block of anchors: its head, with windows, and the merged best of all windows."""

    def run(key: tuple[pa.Scalar, ...], both: pa.Table) -> pa.Table:
        parts = {x["head"]: x for x in both.to_pylist()}
        if len(parts) < 2:
            return _arrow(_RESULT).empty_table()
        ids, pos_ids, pos = (ints(parts[True][c]) for c in ("ids", "positive_ids", "windows"))
        neg_ids, neg = (ints(parts[False][c]).reshape(len(ids), positives, k) for c in ("ids", "scores"))
        a, w, r = np.nonzero(neg > NONE)
        at = a * positives + w
        columns = [ids[a], pos_ids[at], (r + 1).astype(np.int32), neg_ids[a, w, r], pos[at], neg[a, w, r]]
        return pa.Table.from_arrays([pa.array(x) for x in columns], schema=_arrow(_RESULT))

    return run


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _best(anchors: DataFrame, rows: DataFrame, blocks: int, chunk: int, k: int, choose) -> DataFrame:
    """(i, ids, scores): what choose keeps of each block of anchors over all the blocks of rows it meets. Both have first and
    last, the range of blocks on the other side that a block meets."""
    every = F.explode(F.sequence("first", "last"))
    own = ["anchor", "chunk", "ids", "labels", "windows", "matrix"]
    left = anchors.where("first <= last").select(F.col("block").alias("i"), every.alias("j"), *own)
    right = rows.where("first <= last").select(every.alias("i"), F.col("block").alias("j"), *own)
    tiles = left.unionByName(right).groupBy("i", "j", "chunk").applyInArrow(_multiply(chunk), _TILE)
    best = tiles.groupBy("i", "j").applyInArrow(_add(choose), _BEST)
    while blocks > 1:
        best = best.withColumn("j", F.floor(F.col("j") / FAN).cast("int")).groupBy("i", "j").applyInArrow(_merge(k), _BEST)
        blocks = math.ceil(blocks / FAN)
    return best.select("i", "ids", "scores")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 5, share: tuple[int, int] = (4, 5), block: int = BLOCK, chunk: int = CHUNK,
) -> DataFrame:
    """For each anchor and each of its nearest rows of the same label, the nearest rows of another label that score from share
    of the positive's score up to all of it: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(256 * x), and a score is their integer inner product; higher scores come first, ties by smaller id.
    Rows with a null id, label or vector, or with a null or non-finite component, take no part; neither do rows with a component
    so large that a score might not fit 64 bits (from 1.4 million at 64 dimensions). Of rows that share an id, the one of
    the smallest label, then vector counts. Short vectors are filled up with zeros, an empty one has score 0 with all.
    An anchor without positives, or a window without rows, gives no rows, and an empty table none at all. Other columns are not read.
    """
    spark, mark = vectors.sparkSession, fresh("anchor", vectors.columns)
    flagged = vectors.withColumn(mark, F.coalesce(is_anchor, F.lit(False)))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    plain = flagged.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vec).cast("array<double>").alias("vec"), F.col(mark).alias("anchor")).where("id IS NOT NULL AND label IS NOT NULL").where(F.col("vec").isNotNull() & finite)
    one = plain.groupBy("id").agg(F.min(F.struct("label", "vec", "anchor")).alias("row")).select("id", "row.*", F.pmod(F.xxhash64("row.label"), F.lit(LABELS)).cast("int").alias("bucket"))
    one = materialize(one, "rows")
    wide = one.agg(F.coalesce(F.max(F.size("vec")), F.lit(0))).first()[0]
    chunk = max(1, chunk, math.ceil(wide / MAX_CHUNKS))
    chunks = max(1, math.ceil(wide / chunk))
    largest = math.isqrt((2**63 - 1) // max(1, wide))
    fits = one.where(F.forall("vec", lambda x: F.abs(F.floor(256 * x)) <= largest) if wide else F.lit(True))
    counts = {r["bucket"]: r for r in fits.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("a")).collect()}
    # The blocks of a bucket of labels are numbered one after another, separately for rows and for anchors.
    per = {side: [math.ceil(counts[g][side] / block) if g in counts else 0 for g in range(LABELS)] for side in ("n", "a")}
    start = {side: [sum(p[:g]) for g in range(LABELS)] for side, p in per.items()}
    n_rows, n_anchors = sum(per["n"]), sum(per["a"])
    if not n_anchors:
        return spark.createDataFrame([], _RESULT)

    def of(values: list[int]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("bucket") + 1)

    def packed(side: str, rows: DataFrame) -> DataFrame:
        number = (of(start[side]) + F.pmod(F.xxhash64("id"), of(per[side])).cast("int")).alias("block")
        return rows.select(F.lit(side == "a").alias("anchor"), number, "bucket", "id", "label", "vec").groupBy("anchor", "block", "bucket").applyInArrow(_pack(chunk, chunks), _BLOCK)

    blocks = materialize(packed("n", fits).unionByName(packed("a", fits.where("anchor"))), "blocks")
    anchors, rows = blocks.where("anchor"), blocks.where("NOT anchor")

    def within(side: str) -> list[Column]:
        return [of(start[side]).alias("first"), (of(start[side]) + of(per[side]) - 1).alias("last")]

    found = _best(anchors.select("*", *within("n")), rows.select("*", *within("a")), n_rows, chunk, positives, _positives(positives))
    found = materialize(found.select(F.col("i").alias("block"), F.col("ids").alias("positive_ids"), F.col("scores").alias("windows")), "positives")
    windowed = anchors.drop("windows").join(found, "block")
    every = lambda n: [F.lit(0).alias("first"), F.lit(n - 1).alias("last")]
    best = _best(windowed.select("*", *every(n_rows)), rows.select("*", *every(n_anchors)), n_rows, chunk, negatives, _negatives(positives, negatives, share))
    none = F.lit(None).cast("binary")
    head = windowed.where("chunk = 0").select(F.lit(True).alias("head"), F.col("block").alias("i"), "ids", none.alias("scores"), "positive_ids", "windows")
    best = best.select(F.lit(False).alias("head"), "i", "ids", "scores", none.alias("positive_ids"), none.alias("windows"))
    return head.unionByName(best).groupBy("i").applyInArrow(_rows(positives, negatives), _RESULT)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of embeddings: anchors are the rows whose vec_id is divisible by 100; where vec_id is divisible by 7,
    label first becomes (label + 1) % 10. Nulls, repeated rows and empty tables as in hard_negatives."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END").alias("label"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.e, r.e)::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
