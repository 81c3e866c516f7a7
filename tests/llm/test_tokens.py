"""Token files, the encoder, and packing: exact round trips."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corvane.llm import packing, token_output
from corvane.llm.common import new_path
from corvane.llm.encoding import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
REAL = Tokenizer.from_file(PATH)


def ids_of(text):
    return REAL.encode(text or "", add_special_tokens=False).ids


def test_encoder_is_the_tokenizer():
    r = random.Random(3)
    texts = ["".join(r.choice(" \n\t\r\x0b  ab'sé1.,!\x1c\x85世") for _ in range(r.randint(0, 30))) for _ in range(3000)]
    texts += ["<|endoftext|> a", None, "", "word " * 3000]
    coder = Encoder(PATH, entries=500)
    for _ in range(2):  # with and without room for new pieces
        for text, ids in zip(texts, coder.encode_many(texts), strict=True):
            assert ids.tolist() == ids_of(text)
    other = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not other.by_piece and len(other.encode_many(["Some words"])[0])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=70))
def test_code_round_trip(ranks):
    control, data = token_output.pack(np.array(ranks, np.uint32))
    found = token_output.unpack(control, data)
    assert found[: len(ranks)].tolist() == ranks and not found[len(ranks) :].any() and len(found) % 4 == 0


def test_token_files(spark, docs, empty):
    path = token_output.write_tokens(docs, new_path(spark, "t"), PATH, block_tokens=50)
    got = sorted(token_output.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    want = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [i for i, _ in want]
    start = 0
    for r, (_, text) in zip(got, want, strict=True):
        ids = [*ids_of(text), 0]
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (start, len(ids), np.array(ids, "<u4").tobytes())
        start += len(ids)
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").limit(3).collect()
    assert ranks[0]["n"] >= ranks[1]["n"] >= ranks[2]["n"]
    assert token_output.read_tokens(spark, token_output.write_tokens(empty, new_path(spark, "t"), PATH)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 10), max_size=40))
def test_first_fit_decreasing(lengths):
    rooms, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        b = next((j for j, r in enumerate(rooms) if r >= lengths[i]), len(rooms))
        rooms += [10] * (b == len(rooms))
        rooms[b] -= lengths[i]
        want[i] = b
    assert packing.first_fit_decreasing(lengths, 10) == [want[i] for i in range(len(lengths))]


def test_packing(docs, empty):
    rows = packing.pack_documents(docs, PATH, capacity=64, group_docs=4).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["start"], bytes(r["ids"]), r["doc_tokens"]))
        assert len(r["ids"]) == 4 * r["length"]
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    for i, text in ((r["doc_id"], r["text"]) for r in docs.collect()):
        if i == 9:
            assert len(by_doc[9]) == 2
            continue
        ids = np.array([*ids_of(text), 1], "<u4")
        assert b"".join(p for _, p, _ in sorted(by_doc[i])) == ids.tobytes() and {n for _, _, n in by_doc[i]} == {len(ids)}
    assert packing.pack_documents(empty, PATH).count() == 0
    first = packing.digest(packing.pack_documents(docs, PATH)).orderBy("sequence_id", "offset").collect()
    assert first[0]["ids_crc32"] == first[0]["ids_crc32"] & 0xFFFFFFFF and zlib


def test_groups_by_bytes(spark):
    """Long texts make more groups; padding stays little; every id is in one piece."""
    import public_tokenizers

    from corvane.llm import packing

    docs = spark.range(400).selectExpr("id as doc_id", "repeat('word and more ', cast(1 + (id * 37) % 400 as int)) as text")
    path = public_tokenizers.path("byte_bpe_50k.json")
    few, many = packing.pack_documents(docs, path).collect(), packing.pack_documents(docs, path, group_bytes=200_000).collect()
    for pieces, groups in ((few, 1), (many, 5)):
        assert len({p["sequence_id"] >> 32 for p in pieces}) >= groups
        ends = {}
        for p in pieces:
            ends[p["sequence_id"]] = max(ends.get(p["sequence_id"], 0), p["offset"] + p["length"])
        total = sum(p["length"] for p in pieces)
        assert total == sum({p["doc_id"]: p["doc_tokens"] for p in pieces}.values()) and len(ends) <= 1.01 * total / 2048 + len({s >> 32 for s in ends})  # at most one sequence of each group is left open


def test_pieces_of_a_batch_are_looked_up_once():
    """A few megabytes of an Arrow batch are one run; ids are those of the whole texts."""
    import pyarrow as pa

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [f"{'some words of a text ' * 50}{i}" for i in range(3000)]
    part = pa.RecordBatch.from_arrays([pa.array([0] * 3000, pa.int32()), pa.array(range(3000), pa.int64()), pa.array(texts)], ["shard", "doc_id", "text"])
    coded, counts = token_output._tokenizer(path, 0)(iter([part]))
    tokenizer = Tokenizer.from_file(path)
    for i in (0, 1999, 2999):
        assert np.frombuffer(coded.column(2)[i].as_py(), "<u2").tolist() == [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 0]
    assert np.frombuffer(counts.column(3)[0].as_py(), np.int64)[0] == 3000
