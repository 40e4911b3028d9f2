"""Byte-level BPE: vectorised pre-tokenisation and cached pair merging.

Pre-tokenisation without a regex. Every codepoint gets a class (letter, number, blank, other white space, anything
else, apostrophe before a contraction). The split pattern is then a finite automaton over classes whose transition
functions form a small monoid under composition; composing is associative, so the automaton runs as a scan: many
stretches of the text are scanned side by side, one table look-up per codepoint composes the prefix functions inside
each stretch, the stretches' functions are chained, and one more look-up turns every prefix function into the state at
its codepoint. State and class say where a piece begins. The slices feed a cache of merged pieces; only pieces not seen
yet are merged. Token offsets of the pieces are kept, so that any piece can be decoded by itself.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import os
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Codepoints scanned at a time (a single longer text is scanned whole), rows made at a time.
BATCH, ROWS = 1 << 19, 512
#: Pieces that the tokenizers library gets as one text.
TOGETHER = 256
#: A worker's cache has two to this many slots.
CACHE_BITS = 20
#: Unicode's White_Space property.
WHITE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

# classes, and states after a codepoint of a class
LETTER, NUMBER, BLANK, SPACE, OTHER, SHORT, LONG = range(7)  # SHORT, LONG: apostrophe before one or two letters
IN_ONE, IN_TWO, DONE = 5, 6, 7  # inside a contraction with so many letters to come; after one
FIRST = 7  # added to the class of a text's first codepoint


@functools.cache
def class_table() -> np.ndarray:
    """Class of every codepoint."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[list(WHITE)] = SPACE
    table[0x20] = BLANK
    return table


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """State after a codepoint, and whether a piece begins at it, white space apart."""
    first, symbol = symbol >= FIRST, symbol % FIRST
    if not first and state in (IN_ONE, IN_TWO):
        return (DONE if state == IN_ONE else IN_ONE), False
    if symbol in (BLANK, SPACE):
        return symbol, True
    if symbol in (SHORT, LONG):
        if first or state not in (OTHER, BLANK):
            return (IN_ONE if symbol == SHORT else IN_TWO), True
        symbol = OTHER
    return symbol, first or state not in (symbol, BLANK)


@functools.cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of function o symbol, state that a function makes of a state, where pieces begin by state and symbol)."""
    symbols = range(2 * FIRST)
    generators = [tuple(_step(s, x)[0] for s in range(8)) for x in symbols]
    functions = {tuple(range(8)): 0}
    queue, rows = [tuple(range(8))], []
    for f in queue:
        row = []
        for g in generators:
            h = tuple(g[s] for s in f)
            if h not in functions:
                functions[h] = len(queue)
                queue.append(h)
            row.append(functions[h])
        rows.append(row)
    begins = [[_step(s, x)[1] for x in symbols] for s in range(8)]
    return np.array(rows, np.uint16).ravel(), np.array(queue, np.uint8), np.array(begins, bool).ravel()


def boundaries(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(the texts joined, its codepoints, where pieces begin and the length, for each text the number of its first piece)."""
    joined = "".join(texts)
    n = len(joined)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lengths) - lengths
    if not n:
        return joined, np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    symbol = class_table()[code]
    first = np.zeros(n, bool)
    first[starts[lengths > 0]] = True

    quote = np.flatnonzero(code == 0x27)
    if len(quote):
        padded = np.concatenate([code, np.zeros(2, np.uint32)])
        last = np.concatenate([first, np.ones(2, bool)])  # no contraction reaches into the next text
        a, b = padded[quote + 1], padded[quote + 2]
        short = np.isin(a, [ord(c) for c in "stmd"]) & ~last[quote + 1]
        pair = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        symbol[quote[short]] = SHORT
        symbol[quote[pair & ~last[quote + 1] & ~last[quote + 2]]] = LONG
    white = (symbol == BLANK) | (symbol == SPACE)
    marked = symbol + FIRST * first.astype(np.uint8)

    compose, apply, begins = _monoid()
    width = max(1, int(np.sqrt(n)) // 2)  # codepoints of a stretch
    rows = -(-n // width)
    grid = np.full(rows * width, LETTER, np.uint8)
    grid[:n] = marked
    grid = np.ascontiguousarray(grid.reshape(rows, width).T).astype(np.intp)
    scan = np.empty((width, rows), np.uint16)
    held = np.zeros(rows, np.intp)
    for j in range(width):  # prefix functions, all stretches side by side
        held = compose.take(held * (2 * FIRST) + grid[j])
        scan[j] = held
        held = held.astype(np.intp)
    entry, state = np.empty(rows, np.intp), 0
    for r, f in enumerate(apply[scan[-1]].tolist()):  # chain of the stretches' functions
        entry[r] = state
        state = f[state]
    states = apply.ravel().take(scan.astype(np.intp) * 8 + entry).T.ravel()[:n]
    before = np.empty(n, np.intp)
    before[0], before[1:] = 0, states[:-1]
    cuts = begins.take(before * (2 * FIRST) + marked)
    # in a run of white space only its last codepoint is cut off, and only if something follows in the same text
    after_white = np.zeros(n, bool)
    after_white[1:] = white[:-1] & white[1:] & ~first[1:]
    followed = np.zeros(n, bool)
    followed[:-1] = ~white[1:] & ~first[1:]
    cuts &= ~after_white | followed
    at = np.append(np.flatnonzero(cuts), n)
    return joined, code, at, np.append(np.searchsorted(at[:-1], starts), len(at) - 1)


def _text(code: np.ndarray) -> str:
    return code.astype("<u4", copy=False).tobytes().decode("utf-32-le", "surrogatepass")


class RankMerges:
    """Pair merging by the ranks of a byte-level BPE's rank file; the merging of one piece is the tiktoken library's."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
        self.model = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def merge(self, code: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces, one after the other, numbers of ids); ``size``: codepoints of each piece in ``code``."""
        merge, text, ends = self.model._encode_single_piece, _text(code), np.cumsum(size)
        made = [merge(text[a:b].encode("utf-8", "surrogatepass")) for a, b in zip((ends - size).tolist(), ends.tolist())]
        n = np.fromiter(map(len, made), np.int64, len(made))
        return np.fromiter(chain.from_iterable(made), np.uint32, int(n.sum())), n


class LibraryMerges:
    """The ids that the tokenizers library gives a piece; its byte-level models split texts by the same pattern."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        # tasks fill the cores already: threads of the library's own, woken for some thousand pieces, only cost CPU
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path) as file:
            known = json.load(file)
        split = known["pre_tokenizer"]
        if not split or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"{path} is no byte-level model without prefix spaces")
        added = known.get("added_tokens") or []
        if known.get("normalizer") or any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} normalizes texts or has added tokens that depend on what surrounds them")
        self.added = {t["content"]: t["id"] for t in added}
        vocabulary = known["model"]["vocab"]
        if any(chr(c) not in vocabulary for c in byte_letters().tolist()):
            raise ValueError(f"{path} has no token for some bytes")
        self.model = Tokenizer(Tokenizer.from_file(path).model)  # the library's merging; pieces come cut and in its letters
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a byte is one character in these files
        for token, number in vocabulary.items():
            self.n_bytes[number] = len(token)

    def merge(self, code: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces, one after the other, numbers of ids); ``size``: codepoints of each piece in ``code``.

        The pieces' bytes go to the library many at a time, as the letters that its files have for bytes; none is a
        blank, so blanks part the pieces. Tokens don't cross these, so that counts of bytes tell whose they are.
        """
        raw = np.frombuffer(_text(code).encode(), np.uint8)
        firsts = np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw))  # byte at which each codepoint begins
        stops = firsts[np.cumsum(size)]
        piece = np.arange(len(size))
        letters = np.full(len(raw) + len(size), 0x20, "<u2")
        letters[np.arange(len(raw)) + np.repeat(piece, np.diff(stops, prepend=0))] = byte_letters()[raw]
        text = letters.tobytes().decode("utf-16-le")
        cuts = [0, *(stops + piece + 1)[TOGETHER - 1 : -1 : TOGETHER].tolist(), len(text)]
        coded = self.model.encode_batch_fast([text[a:b] for a, b in zip(cuts, cuts[1:])], add_special_tokens=False)
        ids = np.concatenate([np.array(c.ids, np.uint32) for c in coded])
        ends = np.cumsum(self.n_bytes[ids])
        last = np.searchsorted(ends, stops)
        if len(ids) != last[-1] + 1 or (ends[last] != stops).any():
            raise ValueError("the library's tokens don't end where the pieces do")
        return ids, np.diff(last, prepend=-1)


@functools.cache
def byte_letters() -> np.ndarray:
    """The character that byte-level models write for each byte: itself if it is printable, else one from 256 on."""
    shown = np.zeros(256, bool)
    for a, b in ((0x21, 0x7F), (0xA1, 0xAD), (0xAE, 0x100)):
        shown[a:b] = True
    return np.where(shown, np.arange(256), 255 + np.cumsum(~shown)).astype("<u2")


_ODD = 0x9E3779B97F4A7C15


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2 ** 64."""
    out = []
    for x in (_ODD, pow(_ODD, -1, 1 << 64)):
        row = np.full(n, x, np.uint64)
        row[0] = 1
        out.append(np.multiply.accumulate(row))
    return out[0], out[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _equal(x: np.ndarray, x_at: np.ndarray, y: np.ndarray, y_at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which stretches of ``n`` (at least 1) codepoints are the same in ``x`` and ``y``."""
    if not len(n):
        return np.zeros(0, bool)
    begin = np.cumsum(n) - n
    each = np.arange(int(n.sum()))
    return ~np.logical_or.reduceat(x.take(np.repeat(x_at - begin, n) + each) != y.take(np.repeat(y_at - begin, n) + each), begin)


class PieceCache:
    """From pieces to their ids, for whole batches at a time.

    A piece is looked up by a 64-bit hash of its codepoints, taken from prefix sums over the batch, and counts as held
    only if its codepoints equal those that are kept beside the ids: colliding hashes cost time and can't change an id.
    Slots are probed by arrays, so only pieces that are not held become strings and are merged. When half of the slots
    are taken, or ids or codepoints fill their room, the cache starts anew: its memory is bounded, whatever the number
    of pieces.
    """

    PROBES = 6

    def __init__(self, merges, bits: int = CACHE_BITS, room: int = 1 << 23):
        self.merges, self.bits, self.room = merges, bits, room
        self._clear()

    def _clear(self) -> None:
        n = 1 << self.bits
        self.key = np.zeros(n, np.uint64)
        self.start, self.count = np.zeros(n, np.int32), np.zeros(n, np.int32)  # of the ids
        self.place, self.length = np.zeros(n, np.int32), np.zeros(n, np.int32)  # of the codepoints; length 0: free
        self.ids, self.used, self.held = np.zeros(1 << 16, np.uint32), 0, 0
        self.code, self.written = np.zeros(1 << 16, np.uint32), 0

    def _hashes(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        up, down = _powers(1 << max(16, int(len(code)).bit_length()))
        sums = np.zeros(len(code) + 1, np.uint64)
        np.cumsum((code + np.uint32(1)) * down[: len(code)], out=sums[1:])
        return _mixed((sums[at[1:]] - sums[at[:-1]]) * up[at[:-1]] + np.diff(at).astype(np.uint64))

    def _find(self, key: np.ndarray, code: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Slot of each piece, -1 if it is not held."""
        mask = (1 << self.bits) - 1
        home = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        slot = np.full(len(key), -1)
        open_ = np.arange(len(key))
        for k in range(self.PROBES):
            if not len(open_):
                break
            s = (home[open_] + k) & mask
            size = self.length[s]
            hit = (size == n[open_]) & (self.key[s] == key[open_])
            some = np.flatnonzero(hit)
            hit[some] = _equal(code, at[open_[some]], self.code, self.place[s[some]].astype(np.int64), n[open_[some]])
            slot[open_[hit]] = s[hit]
            open_ = open_[~hit & (size > 0)]  # beyond a free slot nothing of this home is held
        return slot

    def _hold(self, key, start, count, place, length) -> None:
        mask = (1 << self.bits) - 1
        home = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(key))
        for k in range(self.PROBES):
            s = (home[left] + k) & mask
            free = np.flatnonzero(self.length[s] == 0)
            _, first = np.unique(s[free], return_index=True)
            put = free[first]
            i, j = left[put], s[put]
            self.key[j], self.start[j], self.count[j], self.place[j], self.length[j] = key[i], start[i], count[i], place[i], length[i]
            self.held += len(put)
            left = np.delete(left, put)

    def _append(self, name: str, used: int, more: np.ndarray) -> None:
        store = getattr(self, name)
        if used + len(more) > len(store):
            store = np.concatenate([store[:used], np.zeros(max(len(store), len(more)), np.uint32)])
            setattr(self, name, store)
        store[used : used + len(more)] = more

    def encode(self, code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, token offset of each piece and their number); ``at``: where the pieces begin and end."""
        key, length, begins = self._hashes(code, at), np.diff(at), at[:-1]
        slot = self._find(key, code, begins, length)
        start, count = self.start[slot].astype(np.int64), self.count[slot].astype(np.int64)
        new = np.flatnonzero(slot < 0)
        base, full = self.used, False
        if len(new):
            _, first, which = np.unique(key[new], return_index=True, return_inverse=True)
            like = new[first][which]  # of pieces with one hash the first one; those that differ from it are merged each
            alike = length[new] == length[like]
            some = np.flatnonzero(alike)
            alike[some] = _equal(code, begins[new[some]], code, begins[like[some]], length[new[some]])
            other = np.flatnonzero(~alike)
            which[other] = len(first) + np.arange(len(other))
            one = new[np.concatenate([first, other])]
            size = length[one]
            before = np.cumsum(size) - size
            fresh = code.take(np.repeat(begins[one] - before, size) + np.arange(int(size.sum())))
            flat, n = self.merges.merge(fresh, size)
            begin = base + np.cumsum(n) - n
            start[new], count[new] = begin[which], n[which]
            self._append("ids", base, flat)
            full = self.held + len(one) > (1 << self.bits) // 2 or max(base + len(flat), self.written + len(fresh)) > self.room
            if not full:
                self._append("code", self.written, fresh)
                self._hold(key[one], begin, n, self.written + before, size)
                self.used, self.written = base + len(flat), self.written + len(fresh)
        ends = np.concatenate([[0], np.cumsum(count)])
        out = self.ids.take(np.repeat(start - ends[:-1], count) + np.arange(ends[-1]))
        if full:
            self._clear()
        return out, ends


class Encoder:
    """Texts to ids: boundaries() feeds the cache, batch by batch."""

    def __init__(self, merges):
        self.merges, self.cache = merges, PieceCache(merges)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids (unsigned 32-bit) and the token offset of each of its pieces, and last their number."""
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) <= BATCH):
                size += len(texts[stop])
                stop += 1
            _, code, cuts, firsts = boundaries(texts[at:stop])
            ids, ends = self.cache.encode(code, cuts)
            for a, b in zip(firsts.tolist(), firsts[1:].tolist()):
                own = ends[a : b + 1]
                yield ids[own[0] : own[-1]], own - own[0]
            at = stop

    def encode_with_added(self, texts: list[str]) -> Iterator[np.ndarray]:
        """For each text its ids as the library gives them: the model's added tokens in it are ids of their own."""
        added = self.merges.added
        literal = "|".join(map(re.escape, sorted(added, key=len, reverse=True)))  # the longest of those at one place
        split = [re.split(f"({literal})", t) if added else [t] for t in texts]  # texts between, tokens at odd places
        coded = self.encode([part for parts in split for part in parts[::2]])
        for parts in split:
            ids = [np.array([added[p]], np.uint32) if k % 2 else next(coded)[0] for k, p in enumerate(parts)]
            yield ids[0] if len(ids) == 1 else np.concatenate(ids)


@functools.cache
def encoder(kind: str, path: str) -> Encoder:
    """One encoder a worker process, so that its cache lasts over batches and tasks."""
    return Encoder({"ranks": RankMerges, "library": LibraryMerges}[kind](path))


def decode(ids: np.ndarray, tokens: list[bytes], first: int = 0, last: int | None = None) -> bytes:
    """Bytes of the ids from ``first`` up to ``last``, for instance between two offsets."""
    return b"".join(map(tokens.__getitem__, ids[first:last].tolist()))


def encode_documents(docs: DataFrame, path: str, make: Callable | None = None, schema: str = "ids binary, offsets array<long>") -> DataFrame:
    """doc_id and what ``make(ids, offsets, merges)`` gives for each document: by default its ids, little-endian unsigned
    32-bit, and the token offsets of its pieces.

    Null texts count as empty and have no tokens. A null doc_id is kept, repeated rows are encoded each, other columns
    are not read, and an empty table gives an empty result.
    """
    make = make or (lambda ids, ends, _: (ids.astype("<u4").tobytes(), ends.tolist()))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder("ranks", path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [t or "" for t in part.column("text").to_pylist()]
                made = [make(ids, ends, model.merges) for ids, ends in model.encode(texts)]
                yield from pa.table([part.column("doc_id"), *map(pa.array, map(list, zip(*made)))], names=["doc_id", *names]).to_batches()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {schema}")


def _digests(ids: np.ndarray, ends: np.ndarray, merges: RankMerges) -> tuple[int, str, str]:
    back = hashlib.sha256()
    for k in range(0, len(ends) - 1, 1 << 16):  # decoded by stretches of pieces, between their offsets
        back.update(decode(ids, merges.tokens, ends[k], ends[min(k + (1 << 16), len(ends) - 1)]))
    return len(ids), hashlib.sha256(ids.astype("<u4")).hexdigest(), back.hexdigest()


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document: encoded, then decoded again."""
    return encode_documents(docs, path, _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")
