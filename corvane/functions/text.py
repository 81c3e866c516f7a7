"""Cleaning, tokenizing and clipping of text as column expressions. Each function takes and returns columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that results depend on.
SEARCH_STOPWORDS = "a an and are as at be by for from in into is it its of on or that the their this to with you your".split()
TOKEN = r"[A-Za-z0-9][A-Za-z0-9.+_-]*"
SEARCH_TOKEN = r"(?U)[\w][\w.+-]*"
GENERIC_TITLE = r"(?i)^(?:my\s+)?build\s+small\s+hackathon$"
GENERIC_SUMMARY = r"(?i)(?:\bthis\s+(?:is\s+)?(?:space\s+is\s+for|my\s+submission)\b.*\b(?:build[-\s]*small|hackathon)\b)|(?:\bhacka?ton\s+project\b)|(?:^\s*todo\s*$)"
SECRETS = (
    (r"(?i)\b(HF_TOKEN|HUGGINGFACEHUB_API_TOKEN|OPENAI_API_KEY|GITHUB_TOKEN|GH_TOKEN|ANTHROPIC_API_KEY|API_KEY|TOKEN|PASSWORD|SECRET)\b\s*[:=]\s*['\"]?[^'\"\s,;}]+", "$1=[REDACTED_SECRET]"),
    (r"\bBearer\s+[A-Za-z0-9._\-+/=]{16,}\b", "[REDACTED_SECRET]"),
    (r"\bhf_[A-Za-z0-9]{20,}\b", "[REDACTED_SECRET]"),
    (r"\bsk-[A-Za-z0-9_\-]{20,}\b", "[REDACTED_SECRET]"),
    (r"\bghp_[A-Za-z0-9]{20,}\b", "[REDACTED_SECRET]"),
    (r"\bgithub_pat_[A-Za-z0-9_]{20,}\b", "[REDACTED_SECRET]"),
)
HOSTING_TAG = "region:"
STYLE_MARKERS = ("{", "}", ";", "!important", "rgba(", "linear-gradient")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean(c: Column) -> Column:
    """Null to empty, runs of white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))


def stripped(c: Column) -> Column:
    """Null to empty, white space of any kind off both ends."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def slug(c: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(c, "/", -1)


def tokens(c: Column) -> Column:
    """Lower-case tokens, ends stripped of ._-+, one-character tokens dropped."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({TOKEN})"), F.lit(1))
    stripped = F.transform(found, lambda t: F.btrim(F.lower(t), F.lit("._-+")))
    return F.filter(stripped, lambda t: F.length(t) > 1)


def token_variants(raw: Column) -> Column:
    """The whole token without ._+-/ at its ends, then its parts of more than one character if it has several."""
    whole = F.btrim(raw, F.lit("._+-/"))
    parts = F.filter(F.split(whole, r"[._+\-/]+"), lambda p: F.length(p) > 1)
    parts = F.when(F.array_join(parts, "\u0001") == whole, F.array().cast("array<string>")).otherwise(parts)
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(F.concat(F.array(whole), parts))


def search_tokens(folded: Column) -> Column:
    """P10 on text that is already normalised and case-folded: variants of every token, single letters and stopwords dropped, repeats kept."""
    found = F.regexp_extract_all(F.coalesce(folded, F.lit("")), F.lit(f"({SEARCH_TOKEN})"), F.lit(1))
    every = F.flatten(F.transform(found, token_variants))
    return F.filter(every, lambda t: ((F.length(t) > 1) | t.rlike(r"(?U)^\d$")) & ~t.isin(SEARCH_STOPWORDS))


def title_case(c: Column) -> Column:
    """A capital for the first letter of every run of letters, small letters behind it."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substring(r, 2, 2**31 - 1)))), "")


def humanized(slug: Column) -> Column:
    """The parts between - and _, in title case."""
    return title_case(F.array_join(F.filter(F.split(F.translate(slug, "_", "-"), "-"), lambda p: p != ""), " "))


def public_title(c: Column) -> Column:
    """P6."""
    t = clean(c)
    return F.when((t == "") | t.rlike(GENERIC_TITLE), F.lit("Untitled project")).otherwise(t)


def public_summary(c: Column) -> Column:
    """P7."""
    t = clean(c)
    return F.when(t.rlike(GENERIC_SUMMARY), F.lit("")).otherwise(t)


def normalized_tags(c: Column) -> Column:
    """Cleaned tags without empty and hosting ones, first occurrence kept."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), clean), lambda t: (t != "") & ~F.lower(t).startswith(HOSTING_TAG)))


def style_markers(c: Column) -> Column:
    return sum(((F.length(c) - F.length(F.replace(c, F.lit(m), F.lit("")))) / len(m) for m in STYLE_MARKERS), F.lit(0.0))


def is_style_blob(c: Column) -> Column:
    """80 characters or more with at least 8 markers of style sheets that make up over 1.5 % of the text."""
    n = style_markers(c)
    return (F.length(c) >= 80) & (n >= 8) & (n / F.greatest(F.length(c), F.lit(1)) > 0.015)


def embedding_signal(c: Column) -> Column:
    """P15, one value: tags out, white space collapsed, style sheets to nothing."""
    t = clean(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "))
    return F.when(is_style_blob(t), F.lit("")).otherwise(t)


def joined_signals(values: Column) -> Column:
    """P15, an array: cleaned signals without empty and repeated ones, one to a line."""
    return F.array_join(F.array_distinct(F.filter(F.transform(values, embedding_signal), lambda t: t != "")), "\n")


def bounded(c: Column, limit: int) -> Column:
    """Cleaned text, or its head and tail around ` ... `."""
    t, edge = clean(c), max(1, (limit - 5) // 2)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.left(t, F.lit(edge))), F.lit(" ... "), F.ltrim(F.right(t, F.lit(edge)))))


def clipped(c: Column, limit: int, mark: str = " ...", strip: Callable[[Column], Column] = stripped) -> Column:
    """The first `limit` characters, then the mark, if the text is longer. strip: what takes blanks off the ends of the text and of the cut."""
    t = strip(F.coalesce(c, F.lit("")))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(strip(F.left(t, F.lit(limit))), F.lit(mark)))


def short_value(c: Column, limit: int = 84) -> Column:
    """White space collapsed; a longer value is cut three short of the limit, loses spaces and ,.;: at its end, and gets dots."""
    t = clean(c)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.left(t, F.lit(limit - 3)), F.lit(" ,.;:")), F.lit("...")))


def truncated(c: Column, cap: int | Column) -> Column:
    """A struct (text, omitted). The mark of a cut counts towards the cap; a cap no longer than the mark leaves the mark's end; a cap of 0 or less cuts nothing."""
    cap = F.lit(cap) if isinstance(cap, int) else cap
    omitted = F.length(c) - cap
    mark = F.concat(F.lit("\n[truncated "), omitted.cast("string"), F.lit(" chars before privacy filtering]"))
    cut = let(mark, lambda m: F.when(F.length(m) >= cap, F.right(m, cap)).otherwise(F.concat(F.left(c, cap - F.length(m)), m)))
    long = (F.length(c) > cap) & (cap > 0)
    return F.struct(F.when(long, cut).otherwise(c).alias("text"), F.when(long, omitted).otherwise(F.lit(0)).alias("omitted"))


def redacted(c: Column, roots: tuple[tuple[str, str], ...] = ()) -> Column:
    """Path prefixes replaced, the longest first, then six kinds of secrets; an assignment keeps its name."""
    for prefix, name in sorted(roots, key=lambda r: -len(r[0])):
        c = F.replace(c, F.lit(prefix), F.lit(name))
    for pattern, by in SECRETS:
        c = F.regexp_replace(c, pattern, by)
    return c


def label_key(c: Column) -> Column:
    """`&` to and, lower case, anything but letters and digits to one space."""
    return F.trim(F.regexp_replace(F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit(" and "))), "[^a-z0-9]+", " "))


def scatter(key: Column) -> Column:
    """A fixed place for a key, both coordinates in 8..91, from its SHA-256."""
    digest = F.sha2(key, 256)
    at = lambda begin: (F.lit(8) + F.pmod(F.conv(F.substring(digest, begin, 4), 16, 10).cast("long"), F.lit(84))).cast("int")
    return F.struct(at(1).alias("x"), at(5).alias("y"))


def snippet(text: Column, terms: Column, limit: int = 170, folded: Column | None = None) -> Column:
    """At most `limit` characters from half of that before the earliest term on, moved back where the text ends, with dots where it is cut.

    Terms are looked for in `folded`, the cleaned text in the form that terms have; without it in lower case."""
    def shown(flat: Column, end: Column) -> Column:
        start = F.greatest(F.lit(0), end - limit)
        return F.concat(F.when(start > 0, F.lit("... ")).otherwise(F.lit("")), F.trim(F.substring(flat, start + 1, end - start)), F.when(end < F.length(flat), F.lit(" ...")).otherwise(F.lit("")))

    def cut(flat: Column) -> Column:
        where = F.lower(flat) if folded is None else folded
        places = F.filter(F.transform(terms, lambda t: F.instr(where, t) - 1), lambda p: p >= 0)
        end = F.least(F.length(flat), F.greatest(F.lit(0), F.coalesce(F.array_min(places), F.lit(0)) - limit // 2) + limit)
        return let(end, lambda e: shown(flat, e))

    return let(clean(text), cut)


def frontmatter_block(c: Column) -> Column:
    """The lines between a leading `---` and the next `---` or `...`; empty if there is none."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)\A---[ \t]*\n(.*?)\n(?:---|\.\.\.)[ \t]*(?:\n|\z)", 1)


def frontmatter(c: Column) -> Column:
    """Flat `key: value` lines as a map; indented, list and comment lines are skipped, quotes and ` #` comments removed."""
    lines = F.filter(F.split(frontmatter_block(c), "\n"), lambda line: line.rlike(r"^[^\s#-][^:]*:"))
    def value(line: Column) -> Column:
        v = F.trim(F.regexp_replace(F.trim(F.regexp_extract(line, r"^[^:]+:(.*)$", 1)), r"\s#.*$", ""))
        return F.regexp_replace(v, r"""^(['"])(.*)\1$""", "$2")
    entries = F.transform(lines, lambda line: F.struct(F.trim(F.regexp_extract(line, r"^([^:]+):", 1)), value(line)))
    last = F.aggregate(entries, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["col1"]), F.map_from_arrays(F.array(e["col1"]), F.array(e["col2"]))))
    return last


def without_frontmatter(c: Column) -> Column:
    """The text behind its frontmatter; a text without a closed block is only trimmed."""
    rest = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)\A---[ \t]*\n.*?\n(?:---|\.\.\.)[ \t]*(?:\n|\z)", "")
    return F.regexp_replace(rest, r"(?U)\A\s+|\s+\z", "")


def object_or_empty(json: Column) -> Column:
    """A JSON object as a variant; an empty one for anything else."""
    tree = F.try_parse_json(json)
    return F.when(F.schema_of_variant(tree).startswith("OBJECT"), tree).otherwise(F.parse_json(F.lit("{}")))


def list_or_empty(json: Column) -> Column:
    """The items of a JSON list as variants; none for anything else."""
    tree = F.try_parse_json(json)
    return F.when(F.schema_of_variant(tree).startswith("ARRAY"), tree.cast("array<variant>")).otherwise(F.array().cast("array<variant>"))


def prefixes_seen(words: Column, prefixes: list[str]) -> Column:
    """The prefixes that begin some word, each once. None of them may begin another."""
    pattern = f"^({'|'.join(prefixes)})"
    return F.array_distinct(F.transform(F.filter(words, lambda w: w.rlike(pattern)), lambda w: F.regexp_extract(w, pattern, 1)))


def packed_chunks(c: Column, least: int = 28) -> Column:
    """Words joined until a chunk has `least` characters; chunks end with a space but for the last."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))
    def step(s: Column, w: Column) -> Column:
        grown = F.concat(s["held"], w, F.lit(" "))
        full = F.length(grown) >= least
        return F.struct(F.when(full, F.concat(s["out"], F.array(grown))).otherwise(s["out"]).alias("out"), F.when(full, F.lit("")).otherwise(grown).alias("held"))
    end = F.aggregate(F.split(clean(c), " "), start, step)
    rest = F.rtrim(end["held"])
    return F.when(rest == "", end["out"]).otherwise(F.concat(end["out"], F.array(rest)))


def bounded_score(c: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(10), c))


def redaction_label(raw: Column) -> Column:
    """Without its B-, I-, E- or S- prefix, upper case with underscores; PRIVATE if nothing is left."""
    plain = F.regexp_replace(F.coalesce(raw, F.lit("")), "^[BIES]-(?=.)", "")
    joined = F.upper(F.btrim(F.regexp_replace(plain, "[^A-Za-z0-9]+", "_"), F.lit("_")))
    return F.when(joined == "", F.lit("PRIVATE")).otherwise(joined)


def merged_spans(found: Column, least: float = 0.5) -> Column:
    """An array of spans (begin, end, label, score) of enough score, in order, as (begin, end, label) with touching ones merged; a merge of different labels is PRIVATE."""
    kept = F.transform(F.array_sort(F.filter(found, lambda s: s["score"] >= least)), lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"), s["label"].alias("label")))
    none = F.filter(kept, lambda s: F.lit(False))

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        both = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], s["end"]).alias("end"), F.when(last["label"] == s["label"], s["label"]).otherwise(F.lit("PRIVATE")).alias("label"))
        return F.when((F.size(done) > 0) & (s["begin"] <= F.try_element_at(done, F.lit(-1))["end"]), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(kept, none, add)


def redact_spans(text: Column, found: Column, least: float = 0.5) -> Column:
    """A struct (text, labels): merged spans replaced by [LABEL], and how often each label occurs."""

    def of(spans: Column) -> Column:
        behind = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
        pieces = F.transform(spans, lambda s, i: F.concat(F.substring(text, behind(i) + 1, s["begin"] - behind(i)), F.lit("["), s["label"], F.lit("]")))
        rest = F.substring(text, behind(F.size(spans)) + 1, F.length(text))
        names = F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"])))
        counts = F.map_from_arrays(names, F.transform(names, lambda n: F.size(F.filter(spans, lambda s: s["label"] == n))))
        return F.struct(F.concat(F.array_join(pieces, ""), rest).alias("text"), counts.alias("labels"))

    return let(merged_spans(found, least), of)
