"""Spelling variants against all pairs in plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corvane.llm import spelling


def words_of(rows, spoil, least=7):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if spoil and h % 31 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n):
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    best = {w: min(x, key=lambda y: (-n[y], y)) for w, x in near.items() if x}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


def made(seed, alphabet, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice(alphabet) for _ in range(r.randint(7, 10))) for _ in range(n)]
    for _ in range(6 * n):
        w = r.choice(words)
        i = r.randrange(len(w))
        words.append(r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice(alphabet) + w[i:], w[:i] + r.choice(alphabet) + w[i + 1 :]]))
    return [(k, " ".join(r.choice([1, 2, 2, 3, 25]) * [w])) for k, w in enumerate(words)]


@pytest.mark.parametrize(("alphabet", "group", "batch"), [("abcÿ", 1_000_000, 2_000_000), ("ab", 30, 200), ("abé", 8, 50)])
def test_same_as_all_pairs(spark, alphabet, group, batch):
    """Few letters, so that repeated letters give one pair in several ways; small groups are split down to one code point."""
    rows = made(len(alphabet), alphabet)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = spelling.spelling_variants(docs, group=group, batch=batch)
    want = brute(words_of(rows, False))
    assert sorted(map(tuple, got.collect()), key=str) == want and sum(x[1] is not None for x in want) > 5


def test_long_and_null_texts(spark, docs):
    long = "a" * 4000
    rows = [(1, f"{long} {long} {long}b {long}b"), (2, None), (3, ""), (None, "Straßenbahn STRASSENBAHN straßenbahn×÷"), (4, "Überweg überweg Überweg"), (4, "Überweg überweg Überweg"), (5, "receive " * 40 + "recieve receeve receeve recevve " * 2)]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    for spoil in (False, True):
        assert sorted(map(tuple, spelling.spelling_variants(frame, spoil=spoil).collect()), key=str) == brute(words_of(rows, spoil))
    assert spelling.spelling_variants(docs).count() == len(words_of([(r["doc_id"], r["text"]) for r in docs.collect()], False))
    assert spelling.spelling_variants(docs.limit(0)).collect() == []


def test_chains_end_at_the_last_form(spark):
    chain = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk"]
    forms = spark.createDataFrame(list(zip(chain, chain[1:], strict=False)), "word string, form string")
    assert {tuple(r) for r in spelling.roots(forms).collect()} == {(w, chain[-1]) for w in chain[:-1]}
    assert spelling.roots(forms.limit(0)).collect() == []


def test_trie_levels():
    mids = np.array(["", "a", "ab", "b", "b"], "<U2").view(np.uint32).reshape(5, 2)
    trie = spelling.levels(mids, np.array([0, 1, 2, 1, 1]), np.array([0, 0, 0, 0, 1]))
    assert [len(x["end"]) for x in trie] == [2, 3, 1] and trie[0]["end"].tolist() == [0, -1] and trie[1]["end"].tolist() == [1, 3, 4] and trie[1]["child"].tolist() == [0, 1, 1, 1]
