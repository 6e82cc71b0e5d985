"""Token ids of text columns by a ready-made tokenizer file, cached per word.

``encoder(path)`` gives a function from an Arrow string column to flat ids and
document offsets. Its ids equal ``Tokenizer.encode(text,
add_special_tokens=False)``. For a tokenizer that drops white space and lower-cases
(word BPE with word ends), a text's ids are those of its white-space separated
words one after another, so every distinct word is encoded once per Python
worker; any other tokenizer file is applied to whole texts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .words import Words, buffers, gathered, worker_state

FRONT = 1 << 18          # slots of the table that is asked first, by the low bits of the word's hash
CACHE_WORDS = 1_000_000  # distinct words remembered per Python worker; beyond that the cache starts anew
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,!?;:"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True

# The pieces into which the tokenizer file's split pattern cuts words of these signs
# (an apostrophe has rules of its own and stays out).
_SIMPLE = re.compile("[a-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f!-&(-/:-@\\[-`{-~]+")
_PIECE = re.compile("[a-z\u00c0-\u024f]+|[0-9]|[!-&(-/:-@\\[-`{-~]+")

Encode = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def word_ended(spec: dict) -> bool:
    """Whether ids of a text are the ids of its white-space separated words, and
    case does not matter: white space removed by the split, words closed by a suffix."""
    norm = spec.get("normalizer") or {}
    kinds = [x.get("type") for x in norm.get("normalizers", [norm])]
    pre = spec.get("pre_tokenizer") or {}
    split = next((x for x in pre.get("pretokenizers", [pre]) if x.get("type") == "Split"), {})
    pattern = (split.get("pattern") or {}).get("Regex", "")
    return ("Lowercase" in kinds and split.get("behavior") == "Removed" and bool(split.get("invert"))
            and r"[\p{L}]+" in pattern and r"[^\s\p{L}\p{N}]+" in pattern
            and bool((spec.get("model") or {}).get("end_of_word_suffix")))


class _WordCache:
    """Sorted word hashes with the ids of each word. Words are told apart by a 64-bit hash."""

    def __init__(self, tok, ends: np.ndarray):
        self.tok, self.ends, self.age = tok, ends, 0  # ends[i]: token i closes a word
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.lo = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int32)
        self.pool = np.zeros(1 << 20, self.kind())
        self.used = 0
        self.age += 1
        self.front_key = np.zeros(FRONT, np.uint64)
        self.front_lo = np.zeros(FRONT, np.int64)
        self.front_count = np.full(FRONT, -1, np.int32)  # an empty slot

    def kind(self):
        return np.uint16 if len(self.ends) <= 1 << 16 else np.uint32

    def _encode_new(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words with each word's position and length in them.

        Words of Latin letters, ASCII digits and ASCII signs go in one call: the
        tokens that close a piece tell where each piece ends, and the split
        pattern tells how many pieces a word has. All others go one by one.
        """
        text = [w.decode("utf-8") for w in words]
        pieces = np.zeros(len(text), np.int64)
        for k, t in enumerate(text):
            if t.isalpha():
                pieces[k] = max(t) < "\u0250" and "\u0130" not in t
            elif _SIMPLE.fullmatch(t):
                pieces[k] = len(_PIECE.findall(t))
        joint = np.flatnonzero(pieces)
        flat, count = np.zeros(0, np.int64), np.zeros(len(text), np.int64)
        lo = np.zeros(len(text), np.int64)
        if len(joint):
            ids = np.array(self.tok.encode_batch_fast([" ".join([text[k] for k in joint])],
                                                      add_special_tokens=False)[0].ids, np.int64)
            cut = np.flatnonzero(self.ends[ids]) + 1
            to = np.cumsum(pieces[joint])
            if len(cut) == to[-1] and cut[-1] == len(ids):
                edge = np.concatenate([[0], cut[to - 1]])
                flat, lo[joint], count[joint] = ids, edge[:-1], np.diff(edge)
            else:
                pieces[:] = 0
        rest = np.flatnonzero(pieces == 0)
        if len(rest):
            own = [e.ids for e in self.tok.encode_batch_fast([text[k] for k in rest], add_special_tokens=False)]
            count[rest] = [len(r) for r in own]
            lo[rest] = len(flat) + np.cumsum(count[rest]) - count[rest]
            flat = np.concatenate([flat, *(np.array(r, np.int64) for r in own)])
        return flat, lo, count

    def of(self, h: np.ndarray, word: Callable[[int], bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pool position and length of the ids of every word ``k`` with hash ``h[k]`` and bytes ``word(k)``. Most words
        stand in their slot; the others are looked up, or encoded, and take the slot over."""
        slot = (h & np.uint64(FRONT - 1)).astype(np.int64)
        hit = (self.front_key[slot] == h) & (self.front_count[slot] >= 0)
        rest = np.flatnonzero(~hit)
        found = None
        if len(rest):
            keys, one, back = np.unique(h[rest], return_index=True, return_inverse=True)
            age = self.age
            lo, count = self.lookup(keys, lambda k: word(rest[one[k]]))
            if self.age != age and hit.any():
                return self.of(h, word)  # the cache started anew: what the slots held before is gone
            found = lo[back], count[back]
        lo, count = self.front_lo[slot], self.front_count[slot].astype(np.int64)
        if found is not None:
            lo[rest], count[rest] = found
            at = slot[rest[one]]
            self.front_key[at], self.front_lo[at], self.front_count[at] = keys, lo[rest[one]], count[rest[one]]
        return lo, count

    def lookup(self, keys: np.ndarray, word: Callable[[int], bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pool position and length of the ids of each distinct key; ``word(k)`` gives the bytes of key ``k``."""
        if len(self.keys) + len(keys) > CACHE_WORDS:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            flat, lo, count = self._encode_new([word(k) for k in new])
            if self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(flat)), self.pool.dtype)])
            self.pool[self.used:self.used + len(flat)] = flat
            lo = self.used + lo
            self.used += len(flat)
            at_new = at[new]
            self.keys = np.insert(self.keys, at_new, keys[new])
            self.lo = np.insert(self.lo, at_new, lo)
            self.count = np.insert(self.count, at_new, count)
            at = np.searchsorted(self.keys, keys)
        return self.lo[at], self.count[at]


def encoder(path: str) -> Encode:
    """The column encoder of a tokenizer file; it is loaded once per Python worker.

    A null text has no ids. Returns ``encode(column) -> (ids, offsets)``.
    """
    state = worker_state()
    if path in state:
        return state[path]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    suffix = (spec.get("model") or {}).get("end_of_word_suffix") or ""
    size = tok.get_vocab_size(with_added_tokens=True)
    ends = np.zeros(max(size, max(tok.get_vocab().values()) + 1), bool)
    for t, i in tok.get_vocab().items():
        ends[i] = bool(suffix) and t.endswith(suffix)
    kind = np.uint16 if len(ends) <= 1 << 16 else np.uint32

    def whole(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        rows = [np.array(e.ids, kind) for e in
                tok.encode_batch_fast([t or "" for t in col.to_pylist()], add_special_tokens=False)]
        off = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(r) for r in rows], out=off[1:])
        return (np.concatenate(rows) if rows else np.zeros(0, kind)), off

    if not word_ended(spec):
        state[path] = whole
        return whole
    cache = _WordCache(tok, ends)
    special = [t["content"] for t in spec.get("added_tokens", [])]

    def by_word(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, _ = buffers(col)
        low = bytes(raw).lower()
        if any(s.lower().encode() in low for s in special):
            return whole(col)  # a special token's string may stand in a text: let the library cut it out
        w = Words(col, lower=True)
        # a single stop after a letter is a word of its own for the tokenizer, too
        start, end, data = w.start, w.end, w.data
        wide = end - start >= 2
        last = np.where(wide, end - 1, start)
        prev = np.where(wide, end - 2, start)
        prev2 = np.where(end - start >= 3, end - 3, start)
        latin = (data[prev2] == 0xC3) & (data[prev] != 0x97) & (data[prev] != 0xB7) & (end - start >= 3) & (data[prev] >= 0x80)
        cut = wide & _STOP[data[last]] & (_LETTER[data[prev]] | latin) if len(w) else np.zeros(0, bool)
        n = len(w)
        pos = np.arange(n) + np.cumsum(cut) - cut
        total = n + int(cut.sum())
        s, e = np.empty(total, np.int64), np.empty(total, np.int64)
        s[pos], e[pos] = start, end - cut
        s[pos[cut] + 1], e[pos[cut] + 1] = last[cut], end[cut]
        first = np.searchsorted(s, w.off)
        w.start, w.end = s, e
        buf = data.tobytes()
        lo, count = cache.of(w.hashes(), lambda k: buf[s[k]:e[k]])
        ids = gathered(cache.pool, lo, count)
        total_to = np.zeros(total + 1, np.int64)
        np.cumsum(count, out=total_to[1:])
        return ids, total_to[first]

    state[path] = by_word
    return by_word


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
