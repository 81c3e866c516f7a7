"""Packing of token sequences: first-fit decreasing by a tournament tree, in randomised groups of documents.

A document is its ids and one end id. It is cut at every multiple of the capacity; full pieces are sequences of their
own, and what remains is packed whole. Documents fall into groups of about `group_docs`, or fewer long ones, by a seeded hash of id and
length, so that every group holds a random sample of lengths whatever the order of the input, and no group grows with
the corpus. Within a group the pieces go, longest first, to the first sequence with room.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.encoding import binaries, encoder, runs, with_ends

CAPACITY = 2048
END_ID = 1
#: A group holds about so many documents, and so many bytes of text, whichever are fewer.
GROUP_DOCS, GROUP_BYTES = 4096, 32 << 20
SEED = 20_240_601


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each length. The leaves of the tree are the room of each bin, an inner node the most room below it.

    Lengths are taken in falling order, ties by position. A length of 0 goes to the first bin; one above the capacity is an error.
    """
    if not lengths:
        return []
    if max(lengths) > capacity:
        raise ValueError("a piece is longer than a sequence")
    width = 1 << max(0, len(lengths) - 1).bit_length()
    room = [capacity] * (2 * width)
    out = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        need, node = lengths[i], 1
        while node < width:
            node *= 2
            if room[node] < need:
                node += 1
        out[i] = node - width
        room[node] -= need
        node >>= 1
        while node:
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
            node >>= 1
    return out


def _tokenizer(path: str, end_id: int | None):
    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        kind = np.dtype("<u2" if max(coder.vocab_size, (end_id or 0) + 1) <= 1 << 16 else "<u4")
        for part in parts:
            for a, b in runs(part.column(1)):
                flat, lengths = coder.encode_column(part.column(1).slice(a, b - a))
                if end_id is not None:
                    flat, lengths = with_ends(flat, lengths, end_id), lengths + 1
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), pa.array(lengths), binaries(flat.astype(kind), lengths)], ["doc_id", "doc_tokens", "ids"])

    return encode


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int | None = END_ID, group_docs: int = GROUP_DOCS, seed: int = SEED, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row for each piece: doc_id, doc_tokens, start, length, sequence_id, offset, ids (unsigned 32-bit, little-endian).

    Null texts count as empty: one piece that holds the end id (none if there is no end id). Equal rows are packed as
    often as they occur. sequence_id is the group times 2^32 plus the number of the sequence in its group.
    """
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()
    groups = max(1, math.ceil(size["n"] / group_docs), math.ceil(size["b"] / group_bytes))
    coded = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_tokenizer(tokenizer_path, end_id), "doc_id long, doc_tokens long, ids binary")
    keyed = coded.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "doc_tokens"), F.lit(groups)).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        group = table.column("grp")[0].as_py()
        # The order of rows in a group is the shuffle's; packing must not depend on it.
        rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("doc_tokens").to_pylist(), table.column("ids").to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
        pieces = [(d, n, s, min(capacity, n - s), ids) for d, n, ids in rows for s in range(0, n, capacity)]
        bins = first_fit_decreasing([p[3] for p in pieces], capacity)
        filled: dict[int, int] = {}
        offsets = []
        for p, b in zip(pieces, bins, strict=True):
            offsets.append(filled.get(b, 0))
            filled[b] = offsets[-1] + p[3]
        cut = []
        for _, n, s, k, ids in pieces:
            size = len(ids) // n
            cut.append(np.frombuffer(ids, f"<u{size}")[s : s + k].astype("<u4").tobytes())
        return pa.table(
            {
                "doc_id": pa.array([p[0] for p in pieces], pa.int64()),
                "doc_tokens": pa.array([p[1] for p in pieces], pa.int64()),
                "start": pa.array([p[2] for p in pieces], pa.int64()),
                "length": pa.array([p[3] for p in pieces], pa.int64()),
                "sequence_id": pa.array([(group << 32) + b for b in bins], pa.int64()),
                "offset": pa.array(offsets, pa.int64()),
                "ids": pa.array(cut, pa.binary()),
            }
        )

    return keyed.groupBy("grp").applyInArrow(pack, "doc_id long, doc_tokens long, start long, length long, sequence_id long, offset long, ids binary")


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens.
    Nulls, empty and long texts, repeated rows and empty tables as in pack_documents: every id of every row lies in one piece."""
    import public_tokenizers

    return digest(pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json")))
