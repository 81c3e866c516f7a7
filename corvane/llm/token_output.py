"""Token-id output: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Format (a folder): `blocks/` holds Parquet rows (shard, block, start, doc_ids, lengths, control, data). The ids of a
corpus are replaced by their rank in falling order of frequency, so that common ids take one byte. A rank takes 1 to 4
little-endian bytes in `data`; its length less one is a 2-bit field of `control`, four to a byte, lowest bits first. The
ranks of a document are padded with rank 0 to a multiple of four, so that blocks join whole control bytes. Documents
ascend by id within a shard and over the shards; `start` counts the ids of a shard before the block. `ranks/` holds
(rank, token, n); `manifest/` holds (shard, base, n_tokens), base being the ids of all shards before it.
Both tables are bounded, by the vocabulary and by the number of shards. Parquet is only the container: Spark commits it
atomically by task, on any file system, so a lost executor leaves no half-written file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import drop, materialize, new_path, shuffle_width
from corvane.llm.encoding import binaries, encoder, runs, with_ends

END_ID = 0
BLOCK_TOKENS = 1 << 18
#: Bytes of text that are encoded at once: a piece that occurs several times in them is looked up once.
RUN_BYTES = 8_000_000
#: Lengths of the four ranks of a control byte, and where in the data each of their 16 bytes is (16: a zero).
LENGTHS = np.stack([((np.arange(256) >> (2 * i)) & 3) + 1 for i in range(4)], axis=1).astype(np.uint8)
SPAN = LENGTHS.sum(axis=1).astype(np.int64)
_FROM = np.cumsum(LENGTHS, axis=1) - LENGTHS
PLACES = np.where(np.arange(4)[None, None, :] < LENGTHS[:, :, None], _FROM[:, :, None] + np.arange(4), 16).reshape(256, 16).astype(np.int32)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of ranks, padded with zeros to a multiple of four."""
    control, data, _ = pack_runs(ranks, np.array([len(ranks)], np.int64))
    return control.tobytes(), data.tobytes()


def pack_runs(ranks: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(control, data, bytes of data of each run) of runs of ranks, each padded with zeros to a multiple of four."""
    padded = -(-lengths // 4) * 4
    r = np.zeros(int(padded.sum()), np.uint32)
    shift = (np.cumsum(padded) - padded) - (np.cumsum(lengths) - lengths)
    r[np.repeat(shift, lengths) + np.arange(len(ranks))] = ranks
    extra = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    four = extra.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = r.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    upto = np.concatenate([[0], np.cumsum(extra, dtype=np.int64) + np.arange(1, len(extra) + 1)])
    return control.astype(np.uint8), data, np.diff(upto[np.concatenate([[0], np.cumsum(padded)])])


def unpack(control: bytes, data: bytes) -> np.ndarray:
    """All ranks of a block, padding included, by table lookup."""
    c = np.frombuffer(control, np.uint8)
    if not len(c):
        return np.zeros(0, np.uint32)
    d = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(17, np.uint8)])
    spans = SPAN[c]
    begins = np.cumsum(spans) - spans
    places = PLACES[c]
    at = begins[:, None] + places
    at[places == 16] = len(d) - 1
    return d[at].view("<u4").reshape(-1)


def _tokenizer(path: str, end_id: int | None):
    """Documents to ids; behind its last document a task adds a row with the counts of all ids it has seen."""

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        size = max(coder.vocab_size, (end_id or 0) + 1)
        kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        total = np.zeros(size, np.int64)
        names = ["shard", "doc_id", "ids", "counts"]
        for part in parts:
            for a, b in runs(part.column(2), RUN_BYTES):
                flat, lengths = coder.encode_column(part.column(2).slice(a, b - a))
                if end_id is not None:
                    flat, lengths = with_ends(flat, lengths, end_id), lengths + 1
                total += np.bincount(flat, minlength=size)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), part.column(1).slice(a, b - a), binaries(flat.astype(kind), lengths), pa.nulls(b - a, pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int32()), pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([total.tobytes()], pa.binary())], names)

    return encode


def _sum_counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for part in parts:
        for raw in part.column(0).to_pylist():
            one = np.frombuffer(raw, np.int64)
            total = one.copy() if total is None else total + one
    if total is not None:
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["token", "n"])


def token_counts(coded: DataFrame) -> DataFrame:
    """(token, n) over all texts; each task sends one row for each id of the vocabulary at most."""
    return coded.where("counts is not null").select("counts").mapInArrow(_sum_counts, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))


def shard_of(docs: DataFrame, id_col: str, shards: int) -> Column:
    """Index of the id's range; the ranges hold about as many rows each."""
    if shards == 1:
        return F.lit(0)
    probs = [i / shards for i in range(1, shards)]
    bounds = docs.select(F.percentile_approx(id_col, F.array(*map(F.lit, probs)), F.lit(10_000)).alias("b")).first()["b"]
    edges = sorted(set(bounds or []))
    if not edges:
        return F.lit(0)
    # How many edges lie below the id: a search in a sorted array of at most `shards` numbers.
    array = F.array(*[F.lit(int(x)) for x in edges])
    return F.coalesce(F.size(F.filter(array, lambda x: x < F.col(id_col))), F.lit(0))


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", end_id: int | None = END_ID, shards: int | None = None, block_tokens: int = BLOCK_TOKENS) -> str:
    """Encode every text and write the folder described above. Null texts count as empty, null ids come first, equal ids stay side by side.

    Texts are encoded once, to a written table of ids, which is then read to count and to code; only coded bytes are shuffled.
    """
    spark = docs.sparkSession
    shards = shards or shuffle_width(spark)
    keyed = docs.select(shard_of(docs, id_col, shards).cast("int").alias("shard"), F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    plain = materialize(keyed.mapInArrow(_tokenizer(tokenizer_path, end_id), "shard int, doc_id long, ids binary, counts binary"), "plain-ids")
    counts = {r["token"]: r["n"] for r in token_counts(plain).collect()}
    size = max(encoder(tokenizer_path).vocab_size, (end_id or 0) + 1)
    kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
    n = np.zeros(size, np.int64)
    n[list(counts)] = list(counts.values())
    by_rank = np.lexsort((np.arange(size), -n)).astype(np.int32)
    rank_of = np.empty(size, np.uint32)
    rank_of[by_rank] = np.arange(size, dtype=np.uint32)

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a, b in runs(part.column(2)):
                ids = pc.cast(part.column(2).slice(a, b - a), pa.large_binary())
                offsets = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
                lengths = np.diff(offsets) // kind.itemsize
                flat = np.frombuffer(ids.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(kind)
                control, data, sizes = pack_runs(rank_of[flat], lengths)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), part.column(1).slice(a, b - a), pa.array(lengths), binaries(control, -(-lengths // 4)), binaries(data, sizes)], ["shard", "doc_id", "length", "control", "data"])

    def block(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "block", "start", "doc_ids", "lengths", "control", "data"]
        shard, number, start, rows, held = None, 0, 0, [], 0

        def flush() -> pa.RecordBatch:
            ids, lengths, control, data = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int64()), pa.array([start], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([b"".join(control)], pa.binary()), pa.array([b"".join(data)], pa.binary())], names)

        for part in parts:
            for s, *row in zip(*[c.to_pylist() for c in part.columns], strict=True):
                if rows and (s != shard or held >= block_tokens):
                    yield flush()
                    number, start, rows, held = number + 1, start + held, [], 0
                if s != shard:
                    shard, number, start = s, 0, 0
                rows.append(row)
                held += row[1]
        if rows:
            yield flush()

    coded = plain.where("ids is not null").select("shard", "doc_id", "ids").mapInArrow(encode, "shard int, doc_id long, length long, control binary, data binary")
    dealt = coded.repartitionById(shards, "shard").sortWithinPartitions("shard", "doc_id")
    blocks = dealt.mapInArrow(block, "shard int, block long, start long, doc_ids array<long>, lengths array<long>, control binary, data binary")
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(i, int(t), int(n[t])) for i, t in enumerate(by_rank)], "rank int, token int, n long").coalesce(1).write.parquet(f"{path}/ranks")
    sums = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n")).collect()
    totals = dict(sorted((r["shard"], r["n"]) for r in sums))
    base, rows = 0, []
    for shard, tokens in totals.items():
        rows.append((shard, base, tokens))
        base += tokens
    spark.createDataFrame(rows, "shard int, base long, n_tokens long").coalesce(1).write.parquet(f"{path}/manifest")
    drop(spark, plain)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a written folder; ids are little-endian unsigned 32-bit integers.
    A row for every row that was written, null ids and repeated rows too; none of an empty table."""
    table = [r["token"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]
    token_of = np.array(table, "<u4")
    bases = {r["shard"]: r["base"] for r in spark.read.parquet(f"{path}/manifest").collect()}

    def decode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for shard, start, ids, lengths, control, data in zip(*[c.to_pylist() for c in part.columns], strict=True):
                tokens = token_of[unpack(control, data)]
                n = np.array(lengths, np.int64)
                padded = -(-n // 4) * 4
                begins = np.cumsum(padded) - padded
                texts = [tokens[b : b + k].tobytes() for b, k in zip(begins.tolist(), lengths, strict=True)]
                starts = bases[shard] + start + np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts), pa.array(n), pa.array(texts, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return spark.read.parquet(f"{path}/blocks").select("shard", "start", "doc_ids", "lengths", "control", "data").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents, written as ranked variable-length ids and read back from the files.
    Nulls, empty and long texts, repeated rows and empty tables as in write_tokens: a row for every row of documents."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = write_tokens(docs, new_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
