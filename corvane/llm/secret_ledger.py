"""Secret scans by an incremental ledger of blobs.

A version of a path is a row; its text is a blob, named by the SHA-256 of its UTF-8 bytes. The ledger is a Parquet table in a
shared folder with a row for each scan of a blob: the blob, the rules (with their versions) that were run on it, and what
they found. An update names every version's blob, looks up which of the given rules the ledger lacks for it, scans each such
blob once and only with those rules, and appends the rows. A finding is joined back to every path that has the blob. So
copies, and versions that were there before, cost a hash and a lookup, and a changed rule costs a scan with that rule alone.

Which rows have to be scanned is decided on hashes. Texts move only where several rows hold the same unseen blob: all the
rows' blobs that occur more than once or that the ledger knows in part set bits in a filter of FILTER_BITS bits, a row that
misses it is scanned where it lies, and only rows that hit it are joined by blob. A filter that fills up costs shuffles, not results.

Spans are in code points, the end exclusive. Rules match from the left without overlaps, each rule by itself; what its test
rejects is dropped after it has matched, so that it still takes its characters.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import fresh, materialize, new_path, table

#: 2 MB in each task, whatever the number of rows; with two probes it tells apart up to about 2 million blobs well.
FILTER_BITS = 1 << 24
#: Rows of an Arrow batch that are scanned at once.
ROWS = 1000
_SPANS = "array<struct<rule:string,start:int,stop:int>>"
_LEDGER = f"blob binary, rules array<string>, spans {_SPANS}"


@dataclass(frozen=True)
class Rule:
    """A pattern under a name and a version. `within` are lower-case words of which a text must hold one for a match to be
    possible (none: always); `least` is the least length of the group `group`."""

    name: str
    version: int
    pattern: str
    flags: int = re.ASCII
    within: tuple[str, ...] = ()
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"

    def scanner(self) -> Callable[[str, str], list[tuple[int, int]]]:
        pattern = re.compile(self.pattern, self.flags)

        def scan(text: str, lower: str) -> list[tuple[int, int]]:
            if self.within and not any(w in lower for w in self.within):
                return []
            return [m.span() for m in pattern.finditer(text) if len(m[self.group]) >= self.least]

        return scan


#: The three base rules. A run of hexadecimal digits or capitals is matched to its end, so the least length can stand in the pattern.
BASE = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, ("password", "passwd", "secret", "token", "apikey", "api_key"), 2, 12),
    Rule("access", 1, "AKIA[A-Z0-9]{14,}", within=("akia",)),
    Rule("hex", 1, "[0-9a-f]{16,}"),
)
#: What the ledger's scan adds: keys in armour, signed tokens, credentials in urls.
ADDED = (
    Rule("pem", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", within=("private key-----",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", within=("eyj",)),
    Rule("url", 1, r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,256}:[^\s/:@]{1,256}@", within=("://",)),
)
RULES = (*BASE, *ADDED)


def address(text: Column) -> Column:
    """The name of a blob: 32 bytes. A null text is an empty one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _probes(blob: np.ndarray, bits: int) -> np.ndarray:
    """Two places in the filter for each line of 32 bytes."""
    words = blob.view("<u8").reshape(len(blob), 4)
    return (words[:, :2] % np.uint64(bits)).astype(np.int64)


def _filter(blobs: DataFrame, bits: int) -> np.ndarray:
    """The filter's bytes: bits are joined in the executors, at most one row a 64-bit word comes to the driver."""

    def places(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at = _probes(np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint8).reshape(-1, 32), bits).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], ["word", "bits"])

    words = blobs.select("blob").mapInArrow(places, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def _in_filter(blobs: pa.Array, words: np.ndarray) -> np.ndarray:
    at = _probes(np.frombuffer(b"".join(blobs.to_pylist()), np.uint8).reshape(-1, 32), 64 * len(words))
    return ((words[at >> 6] >> (at & 63)) & 1).all(axis=1)


def _scan(rules: tuple[Rule, ...], bits=None):
    """Scans of rows (blob, text, todo); given a filter, of the rows (blob, text) that miss it, by all rules."""
    everything = [r.key for r in rules]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanners = {r.key: (r.name, r.scanner()) for r in rules}
        for part in parts:
            if bits is not None and part.num_rows:
                part = part.filter(pa.array(~_in_filter(part.column(0), bits.value)))
            # A few rows at a time: memory doesn't depend on the size of an Arrow batch.
            for begin in range(0, part.num_rows, ROWS):
                yield scanned(part.slice(begin, ROWS), scanners)

    def scanned(part: pa.RecordBatch, scanners: dict) -> pa.RecordBatch:
        out = []
        for row in zip(*part.columns, strict=True):
            text, keys = row[1].as_py() or "", everything if bits is not None else row[2].as_py()
            lower, spans = text.lower(), []
            for k in keys:
                name, scan = scanners[k]
                spans += [{"rule": k, "start": a, "stop": b} for a, b in scan(text, lower)]
            out.append({"blob": row[0].as_py(), "rules": keys, "spans": spans})
        span = pa.struct([("rule", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])
        return pa.RecordBatch.from_pylist(out, pa.schema([("blob", pa.binary()), ("rules", pa.list_(pa.string())), ("spans", pa.list_(span))]))

    return run


def _hits(bits):
    """Rows of (blob, text) whose blob is in the filter."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                yield part.filter(pa.array(_in_filter(part.column(0), bits.value)))

    return run


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(blob, rules, spans), a row a scan; an empty table where no ledger has been written yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], _LEDGER)
    return spark.read.schema(_LEDGER).parquet(path)


def missing(blobs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, copies, todo): each blob of blobs that lacks a rule, how many rows have it, and the keys of the rules it lacks."""
    known = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("known"))
    every = F.array(*[F.lit(r.key) for r in rules])
    counted = blobs.groupBy("blob").agg(F.count(F.lit(1)).alias("copies")).join(known, "blob", "left")
    return counted.select("blob", "copies", F.coalesce(F.array_except(every, "known"), every).alias("todo")).where(F.size("todo") > 0)


def update(ledger: str, versions: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, filter_bits: int = FILTER_BITS) -> None:
    """Scan what the ledger at this path lacks for the blobs of versions, and append it.

    A null text is an empty blob, scanned like others; equal texts are scanned once, whatever their paths; an empty table
    changes nothing. An update that is lost before its rows are committed leaves the ledger as it was; one run twice at the
    same time writes equal rows twice, which readers take once.
    """
    spark = versions.sparkSession
    texts = versions.select(address(F.col(text)).alias("blob"), F.col(text).alias("text"))
    todo = materialize(missing(texts.select("blob"), read_ledger(spark, ledger), rules), "todo")
    every = [r.key for r in rules]
    # Blobs of one row that lack all rules are scanned in place; all others of the input set the filter's bits.
    simple = todo.where((F.col("copies") == 1) & (F.size("todo") == len(every))).select("blob")
    others = texts.select("blob").distinct().join(simple, "blob", "left_anti")
    bits = spark.sparkContext.broadcast(_filter(others, filter_bits))
    # One Python stage that leaves out and scans: texts go to Python once.
    alone = texts.mapInArrow(_scan(rules, bits), _LEDGER)
    # Copies meet in an aggregate that combines before the shuffle, so that a blob of very many rows is no hot key.
    joined = texts.mapInArrow(_hits(bits), "blob binary, text string").groupBy("blob").agg(F.first("text").alias("text")).join(todo.select("blob", "todo"), "blob")
    alone.unionByName(joined.mapInArrow(_scan(rules), _LEDGER)).write.mode("append").parquet(ledger)


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) for every blob with a finding of these rules; rows that repeat a scan count once."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    own = ledger.select("blob", F.filter("spans", lambda s: F.array_contains(keys, s["rule"])).alias("spans")).where(F.size("spans") > 0)
    return own.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))


def with_findings(versions: DataFrame, ledger: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of versions with a column `spans` of (kind, start, stop), by start and then the rules' order: what the ledger has for its
    blob; an empty array where there is nothing. Repeated rows, nulls in other columns and names that clash stay as they are;
    a column `spans` of one's own is replaced. A blob that many rows share is one row on the small side of the join, which
    the engine splits where it is skewed."""
    blob = fresh("blob", versions.columns)
    kinds = {r.key: (k, r.name) for k, r in enumerate(rules)}
    rank = F.create_map(*[F.lit(x) for key, (k, _) in kinds.items() for x in (key, k)])
    kind = F.create_map(*[F.lit(x) for key, (_, name) in kinds.items() for x in (key, name)])
    sorted_spans = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank[s["rule"]].alias("rank"), s["stop"].alias("stop"), kind[s["rule"]].alias("kind"))))
    known = findings(ledger, rules).select(F.col("blob").alias(blob), F.transform(sorted_spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))).alias("spans"))
    named = versions.drop("spans").withColumn(blob, address(F.col(text)))
    return named.join(known, blob, "left").withColumn("spans", F.coalesce("spans", F.from_json(F.lit("[]"), "array<struct<kind:string,start:int,stop:int>>"))).drop(blob)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the SHA-256 of their spans and the text of all spans, per row of found (doc_id, spans)."""
    base = F.array(*[F.lit(r.name) for r in BASE])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    own = F.filter("spans", lambda s: F.array_contains(base, s["kind"]))
    return found.select("doc_id", *[count(r.name) for r in BASE], F.sha2(listed(own), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op13_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, through a ledger of this run's own. Nulls, copies, repeated rows and empty tables as in update
    and with_findings: a row for every row of documents."""
    docs, ledger = table(spark, sf_dir, "documents").select("doc_id", "text"), new_path(spark, "ledger")
    update(ledger, docs)
    return digest(with_findings(docs, read_ledger(spark, ledger)).select("doc_id", "spans"))


def _spans_sql() -> str:
    """A select of (doc_id, rank, kind, start, stop) for each rule. In front of a rule's pattern the shortest text that leads to a match is
    matched too, so that the lengths of what was matched so far give its place. Letters of either case are written out."""
    def either(pattern: str) -> str:
        word, _, rest = pattern.partition(")")
        return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) + ")" + rest

    parts = []
    for rank, rule in enumerate(RULES):
        pattern = (either(rule.pattern) if rule.flags & re.IGNORECASE else rule.pattern).replace("'", "''")
        found = lambda group: f"regexp_extract_all(coalesce(text, ''), '(?s)(.*?)({pattern})', {group})"  # noqa: B023, E731
        parts.append(
            f"SELECT doc_id, pos, {rank} AS rank, '{rule.name}' AS kind, stop - length(m) AS start, stop FROM (SELECT doc_id, pos, m, tested, sum(length(lead) + length(m)) OVER (PARTITION BY pos ORDER BY i) AS stop FROM ("
            f"SELECT doc_id, pos, generate_subscripts(m, 1) AS i, unnest(lead) AS lead, unnest(m) AS m, unnest(tested) AS tested FROM (SELECT doc_id, pos, {found(1)} AS lead, {found(2)} AS m, {found(2 + rule.group)} AS tested FROM d))) WHERE length(tested) >= {rule.least}"
        )
    return " UNION ALL ".join(parts)


OP13_SQL = f"""
WITH d AS (SELECT doc_id, text, row_number() OVER () AS pos FROM documents),
s AS ({_spans_sql()}),
t AS (SELECT pos, rank, start, kind || ':' || start || ':' || stop AS span FROM s),
g AS (SELECT pos, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM t GROUP BY pos)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (pos)
"""
