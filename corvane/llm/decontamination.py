"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows, each text scanned once.

Normalising works on UTF-8 bytes: A-Z become a-z, every ASCII byte that is no letter or digit becomes a space, and bytes
from 0x80 stay. No byte moves, so the offset of a word in the normalised text is its offset in the original. Runs of
spaces are then joined, and a pattern is ` w1 w2 ... wn `, so that it fits whole words only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import fresh, table

WINDOW = 10
#: Characters of all patterns together that one automaton may hold (some 100 bytes of memory each).
AUTOMATON_CHARS = 2_000_000
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


def windows_of(items: list[tuple[int, bytes | None]], window: int) -> dict[str, tuple[int, list[int]]]:
    """Pattern -> (its words, the sorted ids of the items that hold it)."""
    found: dict[str, tuple[int, set[int]]] = {}
    for item, text in items:
        words = words_of(text or b"")
        for i in range(max(1, len(words) - window + 1) if words else 0):
            part = words[i : i + window]
            found.setdefault((b" " + b" ".join(part) + b" ").decode("latin-1"), (len(part), set()))[1].add(item)
    return {k: (n, sorted(ids)) for k, (n, ids) in found.items()}


class Automaton:
    def __init__(self, patterns: dict[str, tuple[int, list[int]]]):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for text, value in patterns.items():
            self.machine.add_word(text, value)
        if patterns:
            self.machine.make_automaton()
        self.empty = not patterns

    def scan(self, text: bytes) -> tuple[int, np.ndarray | None, set[int], bytes]:
        """(words, which of them are hit, items that occur, the normalised text)."""
        words = words_of(text)
        if self.empty or not words:
            return len(words), None, set(), b""
        joined = b" " + b" ".join(words) + b" "
        hits = list(self.machine.iter(joined.decode("latin-1")))
        if not hits:
            return len(words), None, set(), joined
        # The k-th word lies between the k-th and the next space, and a pattern ends at the space behind its last word.
        spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        last = np.searchsorted(spaces, [end for end, _ in hits])
        mark = np.zeros(len(words) + 1, np.int64)
        items: set[int] = set()
        for at, (_, (n, ids)) in zip(last.tolist(), hits, strict=True):
            mark[at - n] += 1
            mark[at] -= 1
            items.update(ids)
        return len(words), np.cumsum(mark)[:-1] > 0, items, joined


def spans_of(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges of the original text that hit words cover; neighbouring words give one range."""
    plain = np.frombuffer(text.translate(PLAIN), np.uint8) != 32
    edge = np.diff(np.r_[0, plain.astype(np.int8), 0])
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    turn = np.diff(np.r_[0, hit.astype(np.int8), 0])
    return [(int(begins[a]), int(ends[b - 1])) for a, b in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1), strict=True)]


def scan_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """docs with n_words, n_hit, items (sorted ids), spans (byte ranges of the original text) added to its columns.

    A column of docs of one of these names is replaced. Null texts have no words. The benchmark's own windows are
    gathered on the driver, as its size is fixed and doesn't follow the corpus; beyond automaton_chars, more automata
    are built from parts of the windows, and each text is scanned by one after the other.
    """
    limit = automaton_chars * 64
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > limit:
        raise ValueError(f"a benchmark of {size} bytes; at most {limit} are scanned at a time, so scan in parts")
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("binary")).collect()
    patterns = windows_of([(i, bytes(t) if t is not None else None) for i, t in rows if i is not None], window)
    parts, held = [{}], 0
    for k, v in sorted(patterns.items()):
        if held + len(k) > automaton_chars and parts[-1]:
            parts.append({})
            held = 0
        parts[-1][k] = v
        held += len(k)
    shipped = docs.sparkSession.sparkContext.broadcast(parts)

    carry = fresh("text", docs.columns)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = [Automaton(p) for p in shipped.value]
        for batch in batches:
            column = pc.cast(batch.column(batch.schema.get_field_index(carry)), pa.binary())
            n_words, n_hit, items, spans = [], [], [], []
            for value in column:
                raw = value.as_py() or b""
                hit, found = None, set()
                for m in machines:
                    n, h, ids, _ = m.scan(raw)
                    found |= ids
                    if h is not None:
                        hit = h if hit is None else hit | h
                n_words.append(n)
                n_hit.append(0 if hit is None else int(hit.sum()))
                items.append(sorted(found))
                spans.append([] if hit is None else [{"begin": a, "end": b} for a, b in spans_of(raw, hit)])
            keep = [i for i, f in enumerate(batch.schema.names) if f != carry]
            span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.int64())), pa.array(spans, pa.list_(span))], [batch.schema.names[i] for i in keep] + ["n_words", "n_hit", "items", "spans"])

    kept = docs.drop("n_words", "n_hit", "items", "spans")
    carried = docs.withColumn(carry, F.col(text)).drop("n_words", "n_hit", "items", "spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", n_words bigint, n_hit bigint, items array<bigint>, spans array<struct<begin:bigint,end:bigint>>"
    return carried.mapInArrow(scan, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs without the rows that hold a benchmark window, in their own columns, whatever their names. Null and empty texts, and
    texts of any length without a hit, stay; repeated rows stay or go together; a null item id, as an empty benchmark, rejects nothing."""
    clash = {c: fresh(c, docs.columns) for c in docs.columns if c in ("n_words", "n_hit", "items", "spans")}
    flagged = scan_documents(docs.withColumnsRenamed(clash), benchmark, clash.get(id_col, id_col), clash.get(text, text), window)
    return flagged.where(F.col("n_hit") == 0).select(*[F.col(f"`{clash.get(c, c)}`").alias(c) for c in docs.columns])


def digest(scanned: DataFrame) -> DataFrame:
    joined = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return scanned.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scanned for windows of ten words of the benchmark.
    Nulls, empty and long texts, repeated rows and empty tables as in scan_documents: a row for every row of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(scan_documents(docs, table(spark, sf_dir, "benchmark")).drop("text"))


#: DuckDB SQL of op5. Windows are compared as strings of joined words at every position of every document.
OP5_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
occ AS (SELECT p.doc_id, p.i, p.n, w.item_id FROM pos p JOIN win w ON p.n = w.n AND p.s = w.s),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS j FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.j, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hit h USING (doc_id) LEFT JOIN its t USING (doc_id)
"""
