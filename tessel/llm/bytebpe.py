"""Byte-level BPE by a rank file: encoding to ids and decoding, without a regex engine per text.

Pre-tokenisation works on arrays. Every code point has a class (letter, number,
white space, other, apostrophe), refined by what follows it into a symbol; a
small automaton reads the symbols, and a piece starts where the automaton says so.
Each symbol is a function from state to state; such functions compose associatively,
so blocks of the text are composed side by side, the blocks' functions are
scanned in log steps, and each block is replayed from its known state. The slices
found are looked up by hash in a cache of merged pieces; only new distinct slices
are merged, all together.

Ids and the byte position of every token travel as little-endian unsigned 32-bit
numbers in binary columns. Decoding looks the tokens' bytes up and lays them at the
positions, so any run of tokens can be decoded alone. The encoder decodes what it made and
compares it with the text: a hash that two slices share cannot pass unseen.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches
from .words import buffers, gathered, ranged, slices, worker_state

SLICE = 512 << 10          # bytes of text worked on at once (a longer text is worked on alone)
BLOCK = 256                # symbols of a block
CACHE_PIECES = 500_000     # distinct slices remembered per Python worker; beyond that the cache starts anew
SHORT = (8, 16, 48)        # slices up to these numbers of bytes are merged side by side, longer ones by a heap
NONE = np.int64(1 << 40)   # no such pair

# classes of code points
OTHER, LETTER, NUMBER, SPACE, BLANK, QUOTE = range(6)  # BLANK is U+0020, SPACE any other white space

# symbols: a class and what the characters behind say about it
S_OTHER, S_LETTER, S_NUMBER, S_RUN, S_LAST, S_LASTBLANK, S_SHORT, S_LONG = range(8)
# S_RUN: white space before white space or the end; S_LAST, S_LASTBLANK: before anything else;
# S_SHORT, S_LONG: apostrophe before one or two letters that close a contraction

# states: what the piece at hand is made of
IN_OTHER, IN_LETTER, IN_NUMBER, IN_RUN, JOIN, ALONE, TAKE1, TAKE2, DONE = range(9)
# JOIN: a blank that the next run takes along; ALONE: a last white space that is none; TAKE2, TAKE1: letters of a contraction to come
STATES = 9


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """State after, and whether a piece starts, for every symbol (plus 8: the first of a text) and state."""
    after, starts = np.zeros((16, STATES), np.uint8), np.ones((16, STATES), bool)
    fresh = {S_OTHER: IN_OTHER, S_LETTER: IN_LETTER, S_NUMBER: IN_NUMBER, S_RUN: IN_RUN, S_LAST: ALONE,
             S_LASTBLANK: JOIN, S_SHORT: TAKE1, S_LONG: TAKE2}
    for sym, to in fresh.items():
        after[sym], after[sym + 8] = to, to  # by default a piece of its own kind starts
    for state, sym in ((IN_OTHER, S_OTHER), (IN_LETTER, S_LETTER), (IN_NUMBER, S_NUMBER), (IN_RUN, S_RUN)):
        starts[sym, state] = False
    for sym in (S_OTHER, S_LETTER, S_NUMBER):  # a run takes the blank before it along
        starts[sym, JOIN] = False
    for sym in (S_SHORT, S_LONG):  # an apostrophe inside a run of others is one of them
        for state in (IN_OTHER, JOIN):
            after[sym, state], starts[sym, state] = IN_OTHER, False
    for state, to in ((TAKE2, TAKE1), (TAKE1, DONE)):
        after[S_LETTER, state], starts[S_LETTER, state] = to, False
    return after, starts


_AFTER, _STARTS = _automaton()


def class_table() -> np.ndarray:
    """Class of every code point, as the library's own pattern engine sees letters, numbers and white space."""
    import tiktoken
    single = {bytes([i]): i for i in range(256)}
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    every = "".join(map(chr, points))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        # what the pattern does not match has no ids
        kept = bytes(tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every))
        out[[ord(c) for c in kept.decode("utf-8")]] = kind
    out[0x20], out[0x27] = BLANK, QUOTE
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def codepoints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the position of each one's first byte."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int32)
    size = np.ones(len(at), np.int64)
    size[:-1], size[-1:] = np.diff(at), len(data) - at[-1:]
    cp = np.where(size == 1, lead, np.where(size == 2, lead & 31, np.where(size == 3, lead & 15, lead & 7)))
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        cp[more] = cp[more] << 6 | data[at[more] + k] & 63
    return cp, at


def symbols(cp: np.ndarray, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The automaton's symbols; ``first`` are the indices at which texts start."""
    n = len(cp)
    kind = np.full(n + 3, 255, np.uint8)
    kind[:n] = classes[cp]
    letter = np.zeros(n + 3, np.int32)
    letter[:n] = cp
    head = np.zeros(n + 3, bool)
    head[first[first < n]] = True
    head[n:] = True
    kind = kind[:n]
    white = (kind == SPACE) | (kind == BLANK)
    white_next = np.append(white[1:], False) | head[1:n + 1]  # the end of a text counts like white space
    # fixed by the kinds' order: others, letters and numbers are their own symbols
    sym = np.where(white, np.where(white_next, S_RUN, np.where(kind == BLANK, S_LASTBLANK, S_LAST)), kind).astype(np.uint8)
    sym[kind == QUOTE] = S_OTHER
    q = np.flatnonzero(kind == QUOTE)
    if len(q):
        a, b = letter[q + 1], letter[q + 2]
        one = np.isin(a, [ord(c) for c in "stmd"]) & ~head[q + 1]
        two = ~head[q + 1] & ~head[q + 2] & np.isin(a << 8 | b, [ord(x) << 8 | ord(y) for x, y in ("re", "ve", "ll")])
        sym[q[one]], sym[q[two]] = S_SHORT, S_LONG
    sym[head[:n]] += 8
    return sym


def piece_starts(sym: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each symbol, by an associative scan over blocks."""
    n = len(sym)
    blocks = -(-n // BLOCK)
    s = np.full(blocks * BLOCK, 8, np.uint8)
    s[:n] = sym
    s = np.ascontiguousarray(s.reshape(blocks, BLOCK).T).astype(np.intp) * STATES
    after, starts = _AFTER.ravel().astype(np.intp), _STARTS.ravel()
    # function of each block: where it leads from every state
    f = np.tile(np.arange(STATES), (blocks, 1))
    for row in s:
        f = after[row[:, None] + f]
    # functions of all blocks up to each one
    step = 1
    while step < blocks:
        f[step:] = np.take_along_axis(f[step:], f[:-step].copy(), axis=1)
        step *= 2
    state = np.concatenate([[0], f[:-1, 0]]) if blocks else np.zeros(0, np.intp)
    out = np.empty((BLOCK, blocks), bool)
    for k, row in enumerate(s):
        at = row + state
        out[k], state = starts[at], after[at]
    return out.T.ravel()[:n]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the leftmost pair of lowest rank is merged until none is left, by a heap over a linked list."""
    n = len(piece)
    end = list(range(1, n + 1))     # end[i]: end of the part that starts at i
    prev = list(range(-1, n - 1))   # start of the part before
    live = [True] * n
    heap = []
    for i in range(n - 1):
        r = ranks.get(piece[i:i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = end[i]
        if not live[i] or j >= n or end[j] != e:
            continue  # a part of this pair has changed since
        live[j] = False
        end[i] = e
        if e < n:
            prev[e] = i
            r = ranks.get(piece[i:end[e]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[e]))
        h = prev[i]
        if h >= 0:
            r = ranks.get(piece[h:e])
            if r is not None:
                heapq.heappush(heap, (r, h, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class Pairs:
    """Merges of all tokens by the ids of their two parts."""

    def __init__(self, ranks: dict[bytes, int]):
        found = [(ranks[t[:k]] << 32 | ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t))
                 if t[:k] in ranks and t[k:] in ranks]
        keys = np.array([k for k, _ in found], np.int64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([i for _, i in found], np.int64)[order]

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id of the token that ``a`` and ``b`` make, or ``NONE``."""
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == key[hit]
        out = np.full(len(key), NONE)
        out[hit] = self.ids[at[hit]]
        return out


def merge_short(pieces: list[bytes], single: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many slices and each slice's number of them: every round merges, in every slice,
    the leftmost pair of lowest rank."""
    n, wide = len(pieces), max(map(len, pieces), default=0)
    size = np.array([len(p) for p in pieces], np.int64)
    raw = np.frombuffer(b"".join(p.ljust(wide, b"\0") for p in pieces), np.uint8).reshape(n, wide)
    part = single[raw]
    inside = np.arange(1, wide) < size[:, None]
    rank = np.full((n, max(0, wide - 1)), NONE)
    rank[inside] = pairs.of(part[:, :-1][inside], part[:, 1:][inside])
    out, left = np.zeros((n, wide), np.int64), size.copy()
    row = np.arange(n)  # slices still at work
    col = np.arange(wide)
    while len(row) and rank.shape[1]:
        at = rank.argmin(axis=1)
        best = rank[np.arange(len(row)), at]
        done = best == NONE
        if done.any():
            out[row[done]] = part[done]
            go = ~done
            row, part, rank, at, best = row[go], part[go], rank[go], at[go], best[go]
            if not len(row):
                break
        k = np.arange(len(row))
        left[row] -= 1
        keep = np.minimum(col + (col > at[:, None]), wide - 1)  # the right part of the pair goes out
        part = np.take_along_axis(part, keep, axis=1)
        part[k, at] = best
        rank = np.take_along_axis(rank, np.minimum(keep[:, :-1], wide - 2), axis=1)
        rank[:, -1] = NONE
        for near in (at - 1, at):  # the pairs that the new part is in
            ok = (near >= 0) & (near + 1 < left[row])
            rank[k[ok], near[ok]] = pairs.of(part[k[ok], near[ok]], part[k[ok], near[ok] + 1])
            gone = (near >= 0) & ~ok
            rank[k[gone], near[gone]] = NONE
    out[row] = part
    return out[col < left[:, None]], left


class Codec:
    """Encoder and decoder of one rank file; its cache lives as long as the Python worker."""

    def __init__(self, path: str, classes: np.ndarray):
        self.ranks, self.classes = read_ranks(path), classes
        size = max(self.ranks.values(), default=-1) + 1
        by_id = [b""] * size
        for b, i in self.ranks.items():
            by_id[i] = b
        self.length = np.array([len(b) for b in by_id], np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.pairs = Pairs(self.ranks)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.lo, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of slices and each one's number of ids. A slice that is a token needs no merge, as in the library."""
        whole = [self.ranks.get(p) for p in pieces]
        count = np.ones(len(pieces), np.int64)
        todo = np.array([k for k, i in enumerate(whole) if i is None], np.int64)
        size = np.array([len(pieces[k]) for k in todo], np.int64)
        own: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # slices, their counts, their ids
        low = 0
        for high in SHORT:
            some = todo[(size > low) & (size <= high)]
            if len(some):
                ids, n = merge_short([pieces[k] for k in some], self.single, self.pairs)
                own.append((some, n, ids))
            low = high
        for k in todo[size > low]:
            ids = np.array(merge_long(pieces[k], self.ranks), np.int64)
            own.append((np.array([k]), np.array([len(ids)]), ids))
        for some, n, _ in own:
            count[some] = n
        lo = np.cumsum(count) - count
        flat = np.zeros(int(count.sum()), np.uint32)
        direct = np.array([k for k, i in enumerate(whole) if i is not None], np.int64)
        flat[lo[direct]] = [i for i in whole if i is not None]
        for some, n, ids in own:
            flat[gathered(np.arange(len(flat)), lo[some], n)] = ids
        return flat, count

    def _lookup(self, keys: np.ndarray, piece) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool and number of ids for each distinct hash; ``piece(k)`` are the bytes of hash ``k``."""
        if len(self.keys) + len(keys) > CACHE_PIECES:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            flat, count = self.merged([piece(k) for k in new])
            while self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used:self.used + len(flat)] = flat
            lo = self.used + np.cumsum(count) - count
            self.used += len(flat)
            self.keys = np.insert(self.keys, at[new], keys[new])
            self.lo, self.count = np.insert(self.lo, at[new], lo), np.insert(self.count, at[new], count)
            at = np.searchsorted(self.keys, keys)
        return self.lo[at], self.count[at]

    def starts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Byte positions at which pieces start; ``off`` are the texts' offsets."""
        cp, at = codepoints(data)
        first = np.searchsorted(at, np.unique(off[:-1][np.diff(off) > 0]))
        return at[piece_starts(symbols(cp, self.classes, first))]

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``ids``, the byte at which each token starts in its text, and the texts' offsets into both. A null text has no ids."""
        data, off = buffers(col)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
        start = self.starts(data, off)
        end = np.append(start[1:], len(data))
        buf = data.tobytes()
        keys, one, back = np.unique(ranged(data.astype(np.uint64) + np.uint64(1), start, end), return_index=True, return_inverse=True)
        lo, count = self._lookup(keys, lambda k: buf[start[one[k]]:end[one[k]]])
        ids = gathered(self.pool, lo[back], count[back])
        if self.decode(ids).tobytes() != buf:  # two slices shared a hash: merge every slice by itself
            ids, _ = self.merged([buf[a:b] for a, b in zip(start, end)])
        size = self.length[ids]
        at = np.cumsum(size) - size
        bound = np.searchsorted(at, off)
        return ids, at - np.repeat(off[:-1], np.diff(bound)), bound

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of ids."""
        return gathered(self.bytes, self.at[ids], self.length[ids])


def _binary(values: np.ndarray, bound: np.ndarray) -> pa.Array:
    """Runs of ``values`` between the bounds as little-endian unsigned 32-bit numbers in a binary column."""
    raw = np.ascontiguousarray(values, "<u4")
    return pa.Array.from_buffers(pa.large_binary(), len(bound) - 1,
                                 [None, pa.py_buffer(np.ascontiguousarray(bound * 4, np.int64)), pa.py_buffer(raw)]).cast(pa.binary())


def _numbers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Such a column's numbers and bounds."""
    raw, off = buffers(col if not col.null_count else col.fill_null(b""))
    return np.frombuffer(raw.tobytes(), "<u4"), off // 4


def _codec(path: str, shared) -> Codec:
    state = worker_state()
    key = f"bytebpe:{path}"
    if key not in state:
        state[key] = Codec(path, shared.value)
    return state[key]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, starts``: the ids of each whole text and the byte at which each token starts.

    ``path`` names a rank file that every executor can open. A null or an empty text has no ids; null ids and repeated rows are
    kept row by row; an empty table gives none. A very long text is worked on alone: the task holds
    some fifty bytes for each of its bytes. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(class_table())  # 1.1 MB, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, shared)
        for b in slices(batches, limit=SLICE):
            ids, at, bound = codec.encode(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _binary(ids, bound), _binary(at, bound)], names=["doc_id", "ids", "starts"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (bounded_batches(docs).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
            .mapInArrow(run, f"doc_id {kind}, ids binary, starts binary"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The frame of ``encode`` with a column ``decoded`` (binary): the tokens' bytes laid at ``starts``.

    Ids that the rank file does not have, or positions that do not fit the tokens, raise an error. Null ids decode to nothing.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(class_table())
    names = [f.name for f in encoded.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, shared)
        for b in slices(batches, "ids", SLICE):
            ids, bound = _numbers(b.column("ids"))
            if len(ids) and int(ids.max()) >= len(codec.length):
                raise ValueError(f"id {ids.max()} is not in {path}")
            flat = codec.decode(ids)
            size = codec.length[ids]
            at = np.append(0, np.cumsum(size))
            starts, _ = _numbers(b.column("starts"))
            if len(starts) != len(ids) or (at[:-1] - np.repeat(at[bound[:-1]], np.diff(bound)) != starts).any():
                raise ValueError("token positions do not fit the tokens")
            out = pa.Array.from_buffers(pa.large_binary(), b.num_rows,
                                        [None, pa.py_buffer(np.ascontiguousarray(at[bound])), pa.py_buffer(np.ascontiguousarray(flat))])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], out.cast(pa.binary())], names=[*names, "decoded"])

    return encoded.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of the encoded and decoded texts."""
    return decode(encode(docs, path), path).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
