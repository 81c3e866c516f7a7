"""Encoding of whole texts with a public tokenizer file, at the speed of a dictionary.

A byte-level BPE splits a text into pre-tokens and never merges across them. A single space, or a single line feed,
between two characters that are not white space always begins a pre-token (and such a line feed is one); so does a mark
such as a comma behind a letter. So a text may be cut there, each distinct piece encoded once by the tokenizers library, and
the ids of a text gathered by numpy. The memory of pieces takes the first `entries` that a Python worker meets, and serves
all of its tasks; later ones are encoded when they occur. That changes speed, never ids. Tokenizers of another kind encode
whole texts.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Before a piece that stands at the beginning of a text or line; all others stand behind a space. Texts that hold it are encoded whole.
_FIRST = "\x02"
_LINE = "\n"
#: Two characters of white space side by side, of any kind that Unicode or Python calls so.
_PAIR = r"[\s\x0b\x1c-\x1f\x85\p{Z}][\s\x0b\x1c-\x1f\x85\p{Z}]"
_MARKS = ".,;:!?"
_JOINED = 1024


class Encoder:
    """ids of texts under add_special_tokens=False, equal to Tokenizer.encode on the whole text."""

    def __init__(self, path: str, special_as_text: bool = False, entries: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.vocab_size = max(vocabulary.values(), default=-1) + 1
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = spec["model"].get("type", "BPE") == "BPE" and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.special = [] if special_as_text else [x["content"] for x in spec.get("added_tokens", [])]
        self.whole = "|".join([_FIRST, *map(re.escape, filter(None, self.special))])
        # A character of a byte-level token stands for one byte.
        self.bytes_of = np.zeros(self.vocab_size, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(x) for x in vocabulary]
        marks = {m: self.tokenizer.encode(m, add_special_tokens=False).ids for m in _MARKS} if self.by_piece else {}
        self.marks = {m: ids[0] for m, ids in marks.items() if len(ids) == 1}
        self.entries = entries
        self.slots: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, np.int32)
        self.offset = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.count = self.used = 0  # entries and ids that stay

    def _encode_joined(self, pieces: list[str], between: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of pieces without white space, and of each how many, encoded as one text and cut again by byte lengths; None if it can't be cut."""
        joined = between.join(["", *pieces]) if between == " " else between.join(pieces)
        if len(joined.split()) != len(pieces):
            return None
        found = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
        raw = np.frombuffer(joined.encode(), np.uint8)
        at = np.flatnonzero(raw == ord(between))
        if between == " ":
            ends = np.append(at[1:], len(raw))
        else:
            ends = np.append(np.stack([at, at + 1], axis=1).ravel(), len(raw))
        upto = np.cumsum(self.bytes_of[found])
        cuts = np.searchsorted(upto, ends)
        if not len(upto) or cuts[-1] >= len(upto) or (upto[cuts] != ends).any():
            return None
        lengths = np.diff(cuts, prepend=-1)
        if between == _LINE:
            found = found[np.repeat(np.arange(len(lengths)) % 2 == 0, lengths)]
            lengths = lengths[::2]
        return found, lengths

    def _encode_pieces(self, keys: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(keys in a new order, their ids, the length of each)."""
        order, ids, lengths, alone = [], [], [], []
        inner = [k for k in keys if k and k[0] != _FIRST and k != _LINE]
        first = [k for k in keys if len(k) > 1 and k[0] == _FIRST]
        alone += [k for k in keys if not k or k in (_FIRST, _LINE)]
        for group, between in ((inner, " "), (first, _LINE)):
            for begin in range(0, len(group), _JOINED):
                some = group[begin : begin + _JOINED]
                out = self._encode_joined([k[1:] for k in some] if between == _LINE else some, between)
                if out is None:
                    alone += some
                else:
                    order += some
                    ids.append(out[0])
                    lengths.append(out[1])
        texts = [_LINE if k == _LINE else k[1:] if k.startswith(_FIRST) else " " + k for k in alone]
        for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids.append(np.array(found.ids, np.int32))
            lengths.append(np.array([len(ids[-1])]))
        return order + alone, np.concatenate(ids), np.concatenate(lengths)

    def _append(self, keys: list[str], found: np.ndarray, lengths: np.ndarray, count: int, used: int) -> dict[str, int]:
        """Slots for keys behind `count` entries and `used` ids."""
        n, m = count + len(keys), used + len(found)
        if n > len(self.offset):
            self.offset, self.length = np.resize(self.offset, 2 * n), np.resize(self.length, 2 * n)
        if m > len(self.pool):
            self.pool = np.resize(self.pool, 2 * m)
        self.pool[used:m] = found
        self.length[count:n] = lengths
        self.offset[count:n] = used + np.cumsum(lengths) - lengths
        return dict(zip(keys, range(count, n), strict=True))

    def _gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slots, and the length of each."""
        lengths = self.length[slots]
        ends = np.cumsum(lengths)
        return self.pool[np.repeat(self.offset[slots] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)], lengths

    def _learn(self, keys: list[str]) -> dict[str, int]:
        """Slots for new pieces. Those beyond the number of entries hold until the next call only."""
        tails = [k for k in keys if len(k) > 1 and k[-1] in self.marks and k[-2].isalpha()]
        stems = [k[:-1] for k in tails]
        marked = set(tails)
        plain = list(dict.fromkeys([*(k for k in keys if k not in marked), *(s for s in stems if s not in self.slots)]))
        count, used, new = self.count, self.used, {}
        if plain:
            order, found, lengths = self._encode_pieces(plain)
            new = self._append(order, found, lengths, count, used)
            count, used = count + len(order), used + len(found)
        if tails:
            slots = np.array([new[s] if s in new else self.slots[s] for s in stems])
            flat, lengths = self._gather(slots)
            found = with_ends(flat, lengths, np.array([self.marks[k[-1]] for k in tails], np.int32))
            new |= self._append(tails, found, lengths + 1, count, used)
            count, used = count + len(tails), used + len(found)
        if count <= self.entries:
            self.slots.update(new)
            self.count, self.used = count, used
        return new

    def _slots_of(self, keys: list[str]) -> np.ndarray:
        slots = np.fromiter(map(self.slots.get, keys, repeat(-1)), np.int64, len(keys))
        if (missing := np.flatnonzero(slots < 0)).size:
            lost = [keys[i] for i in missing.tolist()]
            new = self._learn(lost)
            slots[missing] = [new[k] for k in lost]
        return slots

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts, how many each has); null counts as empty."""
        column = pc.fill_null(pc.cast(column, pa.large_string()), "")
        if not self.by_piece:
            found = [np.array(self.tokenizer.encode(t.as_py(), add_special_tokens=False).ids, np.int32) for t in column]
            return np.concatenate([np.zeros(0, np.int32), *found]), np.array([len(x) for x in found], np.int64)
        # Two kinds of text take another way: those with special tokens, and those that can only be cut with a look at both sides.
        whole = pc.match_substring_regex(column, self.whole).to_numpy(zero_copy_only=False)
        careful = pc.match_substring_regex(column, _PAIR).to_numpy(zero_copy_only=False) & ~whole
        plain = column.filter(pa.array(~(whole | careful)))
        lines = pc.binary_join_element_wise(pa.scalar(_FIRST, pa.large_string()), pc.replace_substring(plain, "\n", f" {_LINE} {_FIRST}"), pa.scalar("", pa.large_string()))
        lists = pc.split_pattern(lines, " ")
        pieces = lists.flatten().dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        other = []
        for text in column.filter(pa.array(careful)).to_pylist():
            cut = _CUT.split(text)
            cut[0] = _FIRST + cut[0]
            other.append(cut)
        rest = [k for cut in other for k in cut]
        keys = list(dict.fromkeys([*distinct, *rest]))
        place = dict(zip(keys, range(len(keys)), strict=True)) if rest else {}
        slots = self._slots_of(keys)
        own = slots[: len(distinct)][pieces.indices.to_numpy()] if len(distinct) else np.zeros(0, np.int64)
        flat, each = self._gather(np.concatenate([own, slots[np.fromiter((place[k] for k in rest), np.int64, len(rest))]]) if rest else own)
        # Texts in the order plain, careful, whole; then put in their places.
        counts = [pc.list_value_length(lists).to_numpy().astype(np.int64), np.array([len(c) for c in other], np.int64)]
        bounds = np.cumsum(np.concatenate(counts))
        upto = np.concatenate([[0], np.cumsum(each)])
        sizes = np.diff(upto[np.concatenate([[0], bounds])]).astype(np.int64)
        found = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32) for t in column.filter(pa.array(whole)).to_pylist()]
        if not other and not found:
            return flat, sizes
        flat = np.concatenate([flat, *found])
        sizes = np.concatenate([sizes, np.array([len(x) for x in found], np.int64)])
        order = np.argsort(np.concatenate([np.flatnonzero(~(whole | careful)), np.flatnonzero(careful), np.flatnonzero(whole)]))
        starts = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        ends = np.cumsum(sizes)
        return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(len(flat))], sizes

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """One int32 array for each text; None counts as empty."""
        flat, lengths = self.encode_column(pa.array(texts, pa.large_string()))
        return np.split(flat, np.cumsum(lengths)[:-1]) if len(texts) else []


@functools.cache
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """The encoder of this process."""
    return Encoder(path, special_as_text)


def with_ends(flat: np.ndarray, lengths: np.ndarray, end) -> np.ndarray:
    """flat with one more number behind each run: `end`, or each run its own."""
    out = np.empty(len(flat) + len(lengths), flat.dtype)
    last = np.cumsum(lengths + 1) - 1
    inner = np.ones(len(out), bool)
    inner[last] = False
    out[inner] = flat
    out[last] = end
    return out


def binaries(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Runs of numbers as binary values of an Arrow array, without a copy for each."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths * flat.itemsize, out=offsets[1:])
    return pc.cast(pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))]), pa.binary())


def runs(column: pa.Array, size: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many bytes, so that memory doesn't depend on the size of an Arrow batch."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(upto):
        end = int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + size, side="left")) + 1
        yield begin, min(end, len(upto))
        begin = end
