"""URL filters by a Bloom filter cascade, in DataFrame functions only.

A rule is `host/path`; it fits its host and all subdomains where the url's path starts with the rule's path. So a url is
listed if one of its keys is: a suffix of its host joined with a prefix of its path. Only suffixes with as many labels,
and prefixes with as many characters, as some rule has can be listed; all of those over the corpus are the key universe.

Level 1 of the cascade is a Bloom filter of the listed keys, level 2 one of the keys of the universe that level 1 passes
though they aren't listed, level 3 one of the listed keys that level 2 passes, and so on until no key passes wrongly. A
key of the universe is listed exactly if the first level that doesn't pass it has an even number. So urls are judged by
bit tests on literal arrays, without a join. The arrays' size is bounded by MAX_WORDS; a list beyond it is looked up by
an equi-join on the keys instead (`exact_join`), with the same results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import materialize, table

#: 64-bit words of all levels together that a plan may carry (1 MB).
MAX_WORDS = 1 << 17
MAX_LEVELS = 64
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.translate(str.maketrans(UPPER, LOWER)), slash + path


def keys_of(host: Column, path: Column, rules: list[str]) -> Column:
    """The keys of a url that some rule could equal, the longest rule first (ties: the longer host)."""
    shapes = {(host_part.count(".") + 1, len(path_part), len(host_part)) for host_part, path_part in map(split_rule, rules)}
    out = []
    for labels, chars in sorted({(a, b) for a, b, _ in shapes}, reverse=True):
        suffix = F.substring_index(host, ".", -labels)
        fits = (F.size(F.split(host, r"\.")) >= labels) & (F.length(path) >= chars) & (host != "")
        out.append(F.when(fits, F.concat(suffix, F.substring(path, 1, chars))))
    # Longest key first; a key is a text here, so its length is the rule's.
    return F.array_sort(F.array_compact(F.array(*out)), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0))


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    """Double hashing with a seed of its own for each level."""
    one, two = (F.pmod(F.xxhash64(F.lit(2 * level + i), key), F.lit(bits)) for i in range(2))
    return [F.pmod(one + F.lit(i) * two, F.lit(bits)) for i in range(hashes)]


def _bit(at: Column) -> Column:
    """The bit of a position within its word."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))


class Level:
    def __init__(self, number: int, bits: int, hashes: int, words: list[int]):
        self.number, self.bits, self.hashes, self.words = number, bits, hashes, words

    def passes(self, key: Column) -> Column:
        array = F.array(*[F.lit(w).cast("long") for w in self.words])
        test = None
        for at in _positions(key, self.number, self.bits, self.hashes):
            word = F.element_at(array, (F.floor(at / 64) + 1).cast("int"))
            bit = word.bitwiseAND(_bit(at)) != 0
            test = bit if test is None else test & bit
        return test


def listed_by(levels: list[Level], key: Column) -> Column:
    """Exact for keys of the universe: the first level that rejects the key decides."""
    out = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        out = F.when(~level.passes(key), F.lit(level.number % 2 == 0)).otherwise(out)
    return out


def _level(keys: DataFrame, number: int, count: int, rate: float) -> Level:
    hashes = max(1, round(-math.log2(rate)))
    bits = max(64, 64 * math.ceil(count * -math.log(rate) / math.log(2) ** 2 / 64))
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), number, bits, hashes))).alias("at"))
    rows = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(_bit(F.col("at"))).alias("bits")).collect()
    words = [0] * (bits // 64)
    for r in rows:
        words[r["word"]] = r["bits"]
    return Level(number, bits, hashes, words)


def build_cascade(universe: DataFrame, listed: DataFrame, max_words: int = MAX_WORDS) -> list[Level] | None:
    """Levels that tell listed keys from all others of the universe; None if they would be larger than max_words.

    universe, listed: a column `key`, not null. Listed keys that the universe lacks don't count.
    """
    flags = universe.select("key", F.lit(0).alias("l")).unionByName(listed.select("key", F.lit(2).alias("l")))
    both = materialize(flags.groupBy("key").agg(F.max("l").alias("l"), F.min("l").alias("u")).where("u = 0").select("key", (F.col("l") == 2).alias("listed")), "url-keys")
    counts = {r["listed"]: r["n"] for r in both.groupBy("listed").agg(F.count(F.lit(1)).alias("n")).collect()}
    inside, outside = counts.get(True, 0), counts.get(False, 0)
    levels: list[Level] = []
    left = {True: both.where("listed"), False: both.where("not listed")}
    size = {True: inside, False: outside}
    side, words = True, 0
    while size[side] and len(levels) < MAX_LEVELS:
        number = len(levels) + 1
        rate = min(0.5, max(1e-6, size[True] / (math.sqrt(2) * max(1, size[False])))) if number == 1 else 0.5
        need = math.ceil(size[side] * -math.log(rate) / math.log(2) ** 2 / 64) + 1
        if words + need > max_words:
            return None
        level = _level(left[side], number, size[side], rate)
        words += len(level.words)
        levels.append(level)
        left[not side] = left[not side].where(level.passes(F.col("key")))
        size[not side] = left[not side].count() if size[not side] else 0
        side = not side
    return levels if not size[side] else None


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", default: str = "allow", max_words: int = MAX_WORDS) -> DataFrame:
    """pages with host, path, rule and verdict added (columns of these names are replaced).

    Null urls and urls without `://` have an empty host and path, fit no rule, and get the default verdict, as every url does
    that fits no rule. Of several fitting rules the longest wins. An empty table, or no rules, needs no cascade.
    """
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parts = pages.select(*names, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    texts = ["".join(split_rule(r)) for r, _ in rules]
    action = dict(zip(texts, (v for _, v in rules), strict=True))
    if not rules:
        return parts.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keyed = parts.withColumn("__keys", keys_of(F.col("host"), F.col("path"), texts))
    listed = pages.sparkSession.createDataFrame([(t,) for t in action], "key string")
    universe = keyed.select(F.explode("__keys").alias("key")).distinct()
    levels = build_cascade(universe, listed, max_words)
    if levels is None:
        return exact_join(keyed, action, default, names)
    rule = F.try_element_at(F.filter("__keys", lambda k: listed_by(levels, k)), F.lit(1)) if levels else F.lit(None).cast("string")
    with_rule = keyed.withColumn("rule", rule)
    blocks = [t for t, v in action.items() if v != default]
    return with_rule.select(*names, "host", "path", "rule", F.when(F.col("rule").isin(blocks), F.lit("block" if default == "allow" else "allow")).otherwise(F.lit(default)).alias("verdict"))


def exact_join(keyed: DataFrame, action: dict[str, str], default: str, names: list[str]) -> DataFrame:
    """The same judgement by an equi-join on the keys, for lists too long for a cascade in the plan.
    Null keys, repeats and empty tables come out as from the cascade: a row for every row."""
    spark = keyed.sparkSession
    listed = spark.createDataFrame(list(action.items()), "key string, act string")
    rows = keyed.withColumn("__row", F.monotonically_increasing_id())
    found = rows.select("__row", F.posexplode("__keys").alias("__at", "key")).join(listed, "key").groupBy("__row").agg(F.min(F.struct("__at", "key", "act")).alias("__first"))
    out = rows.join(found, "__row", "left")
    return out.select(*names, "host", "path", F.col("__first.key").alias("rule"), F.coalesce("__first.act", F.lit(default)).alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of pages, judged by the four rules; urls that fit none are allowed.
    Null and odd urls, repeated rows and empty tables as in judge_urls: a row for every row of pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, list(RULES)).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(h, s, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT page_id, h || s AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || s) DESC) AS k
  FROM q JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s))
SELECT q.page_id, q.host, q.path, m.rule, coalesce(m.v, 'allow') AS verdict FROM q LEFT JOIN m ON q.page_id = m.page_id AND m.k = 1
"""
