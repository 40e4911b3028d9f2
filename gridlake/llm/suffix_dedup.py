"""Removal of bytes covered by a repeated string of fixed length, decided by suffix arrays.

All strings of LENGTH bytes are judged, none is sampled. What could be equal is brought together first:

1. In each string the GRAM-byte gram of least hash is its anchor (a window minimum, leftmost of equals). Equal strings
   have equal anchors at equal offsets. Neighbouring strings with one anchor form a run; a run is known by its anchor
   and a hash of its bytes. Anchors that occur once have no repeated string. Runs that equal another run are repeated
   throughout. Both are settled by aggregation, map-side combined, without moving text.
2. Of the other runs one of each kind sends its bytes to its anchor. There a run is cut into blocks of STEP neighbouring
   strings, aligned on the anchor. The strings of a block have LENGTH - STEP + 1 bytes in common, its core, so a block
   is STEP - 1 bytes, one symbol for the core, STEP - 1 bytes. Blocks without a partner of the same core are settled.
3. For the rest a suffix array is built over these symbols by linear grouping: suffixes are grouped by their Lyndon
   prefixes, groups are processed in descending order with previous-smaller pointers, and a second sweep emits every
   group in order; there is no recursion and no renaming. A string is repeated if it agrees with its neighbour in the
   array over its whole length.

Anchors with very many different runs (the edges of a passage that a great part of the corpus shares) don't go to one
task: their strings are counted one by one under 128-bit hashes, combined map-side.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, same

#: Bytes of the strings, of the grams that anchor them, strings of a block.
LENGTH, GRAM, STEP = 200, 32, 8
#: Different runs of an anchor that may go to one task.
CROWD = 2000
#: Bytes scanned at a time (a longer text is scanned whole).
BATCH = 1 << 19
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_TOP = np.iinfo(np.uint64).max


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


@functools.lru_cache(8)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for x in (base, pow(base, -1, 1 << 64)):
        row = np.full(n, x, np.uint64)
        row[0] = 1
        out.append(np.multiply.accumulate(row))
    return out[0], out[1]


class Hashes:
    """Hashes of any stretches of a byte array, from prefix sums."""

    def __init__(self, data: np.ndarray, base: int = _BASES[0]):
        n = 1 << max(16, int(len(data)).bit_length())
        self.up, down = _powers(n, base)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[: len(data)], out=self.sums[1:])

    def of(self, start, stop) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.up[start] + np.asarray(stop - start).astype(np.uint64))


def _window_minima(key: np.ndarray, w: int) -> np.ndarray:
    n = len(key)
    grid = np.concatenate([key, np.full(-n % w, _TOP, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of all strings of the texts: text number, start, number of strings, anchor's place in it, anchor, hash.

    The hash is XXH3 of the run's bytes, of another kind than the anchor's, so that both together are 128 bits.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = b"".join(texts)
    data = np.frombuffer(joined, np.uint8)
    names = ("text", "start", "strings", "place", "anchor", "hash")
    if len(data) < length:
        return {k: np.zeros(0, np.int64) for k in names}
    ends = np.cumsum(sizes)
    hashes = Hashes(data)
    at = np.arange(len(data) - gram + 1)
    grams = hashes.of(at, at + gram)
    bits = np.uint64(max(20, int(len(data)).bit_length()))
    key = (grams >> bits << bits) | at.astype(np.uint64)
    owner = (_window_minima(key, length - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    n = len(owner)
    text = np.repeat(np.arange(len(texts)), sizes)[:n]
    cut_ = np.ones(n, bool)
    cut_[1:] = (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(cut_)
    strings = np.minimum(np.diff(start, append=n), ends[text[start]] - length + 1 - start)
    start, strings = start[strings > 0], strings[strings > 0]
    text = text[start]
    own, view = owner[start], memoryview(joined)
    stop = start + strings - 1 + length
    digests = [xxhash.xxh3_64_intdigest(view[a:b], 1) for a, b in zip(start.tolist(), stop.tolist())]
    return {
        "text": text, "start": start - (ends - sizes)[text], "strings": strings, "place": own - start,
        "anchor": grams[own].view(np.int64), "hash": np.array(digests, np.uint64).view(np.int64),
    }


def suffix_array(s: list[int]) -> list[int]:
    """Suffix array of a list of symbols >= 1, by linear grouping (a sentinel 0 is put after it and left out again)."""
    s = [*s, 0]
    n = len(s)
    order = sorted(range(n), key=s.__getitem__)  # by first symbol: the first groups
    place, start, size, alive = [0] * n, [0] * n, {}, [False] * n
    for i, x in enumerate(order):
        place[x] = i
    i = 0
    while i < n:
        j = i
        while j < n and s[order[j]] == s[order[i]]:
            j += 1
        size[i] = j - i
        for k in range(i, j):
            start[order[k]] = i
        i = j
    before = [-1] * n
    # first phase: groups in descending order; a group's suffixes lengthen the Lyndon prefix of what stands before them
    end = n
    while end > 0:
        first = start[order[end - 1]]
        group = order[first:end]
        group.sort()
        count: dict[int, int] = {}
        for x in group:  # previous suffix of a lower group, found along pointers that jump over higher ones
            p = x - 1
            while p >= 0 and start[p] >= first:
                p = before[p] if alive[p] else p - 1
            before[x], alive[x] = p, True
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        levels: dict[int, list[int]] = {}
        for p, c in count.items():
            levels.setdefault(c, []).append(p)
        for c in sorted(levels, reverse=True):  # the more copies of this group follow, the higher
            moved: dict[int, list[int]] = {}
            for p in levels[c]:
                moved.setdefault(start[p], []).append(p)
            for g, members in moved.items():
                if len(members) == size[g]:
                    continue
                top = g + size[g]
                for p in members:  # to the end of their group, as the next higher one
                    top -= 1
                    a, b = place[p], order[top]
                    order[a], order[top] = b, p
                    place[b], place[p] = a, top
                size[top], size[g] = len(members), top - g
                for p in members:
                    start[p] = top
        end = first
    # second phase: the rest of a suffix behind its Lyndon prefix is smaller, hence placed before it
    out, filled, placed = [0] * n, {}, [False] * n
    out[0], placed[n - 1] = n - 1, True
    for i in range(n):
        x = out[i] - 1
        while x >= 0 and not placed[x]:
            g = start[x]
            k = filled.get(g, 0)
            out[g + k], filled[g], placed[x] = x, k + 1, True
            x = before[x]
    return out[1:]


def repeated_strings(segments: list[bytes], places: np.ndarray, strings: np.ndarray, anchors: np.ndarray, length: int = LENGTH, step: int = STEP) -> list[np.ndarray]:
    """For different segments (the bytes of runs) which of their strings also start in another one with the same anchor."""
    data = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    base = np.cumsum(sizes) - sizes
    marks = [np.zeros(int(m), bool) for m in strings]
    # blocks by offset to the anchor: string j of a run has offset place - j, its block is offset // step
    highest, lowest = places // step, (places - strings + 1) // step
    n = highest - lowest + 1
    run = np.repeat(np.arange(len(segments)), n)
    block = np.repeat(highest, n) - (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    head = places[run] - (block * step + step - 1)  # the aligned block's first string, perhaps before the run's first
    first, last = np.maximum(head, 0), np.minimum(head + step - 1, strings[run] - 1)
    hashes, other = Hashes(data), Hashes(data, _BASES[1])
    at = base[run]
    core = np.column_stack([f.of(at + head + step - 1, at + head + length).view(np.int64) for f in (hashes, other)])
    whole = np.column_stack([f.of(at + first, at + last + length).view(np.int64) for f in (hashes, other)])
    key = np.column_stack([anchors[run], block, core])
    _, core_of, core_n = np.unique(key, axis=0, return_inverse=True, return_counts=True)
    core_of = core_of.ravel()
    _, kind_first, kind_of, kind_n = np.unique(np.column_stack([core_of, first - head, last - head, whole]), axis=0, return_index=True, return_inverse=True, return_counts=True)
    kind_of = kind_of.ravel()
    full = kind_n[kind_of] > 1  # the same block elsewhere: all its strings are repeated
    for b in np.flatnonzero(full):
        marks[run[b]][first[b] : last[b] + 1] = True
    kinds_of_core = np.bincount(core_of[kind_first], minlength=len(core_n))
    open_ = kind_first[kinds_of_core[core_of[kind_first]] > 1]
    if not len(open_):
        return marks
    # symbols: bytes, then cores; a place outside a run, and the end of a block, is a symbol of its own
    width = 2 * step
    _, core_symbol = np.unique(core_of[open_], return_inverse=True)
    column = np.arange(step - 1)
    left, right = head[open_][:, None] + column, head[open_][:, None] + length + column
    there = lambda x: (x >= first[open_][:, None]) & (x < last[open_][:, None] + length)
    taken = lambda x: data[np.minimum(at[open_][:, None] + np.maximum(x, 0), len(data) - 1)].astype(np.int64) + 1
    own = 257 + int(core_symbol.max()) + 1 + np.arange(len(open_) * width).reshape(-1, width)
    symbols = np.empty((len(open_), width), np.int64)
    symbols[:, : step - 1] = np.where(there(left), taken(left), own[:, : step - 1])
    symbols[:, step - 1] = 257 + core_symbol.ravel()
    symbols[:, step : width - 1] = np.where(there(right), taken(right), own[:, step : width - 1])
    symbols[:, width - 1] = own[:, width - 1]
    flat = symbols.ravel()
    array = np.array(suffix_array(flat.tolist()), np.int64)
    array = array[array % width < step]  # suffixes that begin a string: step symbols of it
    views = np.lib.stride_tricks.sliding_window_view(flat, step)
    equal = (views[array[1:]] == views[array[:-1]]).all(axis=1)
    hit = np.zeros(len(flat), bool)
    hit[array[1:][equal]] = hit[array[:-1][equal]] = True
    hit = hit.reshape(-1, width)[:, :step]
    for b, row in zip(open_, hit):
        if row.any():
            js = head[b] + np.flatnonzero(row)
            marks[run[b]][js[(js >= first[b]) & (js <= last[b])]] = True
    return marks


def _runs_frame(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop]) <= BATCH):
                    size += len(texts[stop])
                    stop += 1
                found = runs(texts[at:stop], length, gram)
                own = pa.array(found["text"] + at)
                spot = found["start"].astype(np.int64) << 32 | found["strings"].astype(np.int64) << 16 | found["place"].astype(np.int64)
                columns = [batch.column("doc_id").take(own), batch.column("th").take(own), *map(pa.array, (spot, found["anchor"], found["hash"]))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "spot", "anchor", "hash"])
                at = stop

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"doc_id {kind}, th long, spot long, anchor long, hash long")

def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, step: int = STEP, crowd: int = CROWD) -> DataFrame:
    """Runs with repeated strings: doc_id, th (xxhash64 of the text), start, strings, marks (which; null: all of them)."""
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    found = _runs_frame(keyed, length, gram)
    anchors = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("least"), F.max("hash").alias("most"))
    # tables of their own on the joins' aggregated sides, so that Spark may split the rows of a frequent anchor
    shared = cut(anchors.where("n > 1").select(F.col("anchor").alias("known"), (F.col("least") == F.col("most")).alias("settled")))
    release(spark)
    # start, strings and place travel as one number
    spread = {"start": F.shiftright("spot", 32).cast("int"), "strings": F.shiftright("spot", 16).bitwiseAND(F.lit(0xFFFF)).cast("int"), "place": F.col("spot").bitwiseAND(F.lit(0xFFFF)).cast("int")}
    again = cut(found.join(shared, F.col("anchor") == F.col("known")).drop("known"))
    del shared
    release(spark)
    again = again.withColumns(spread).drop("spot")
    settled = again.where("settled").select("doc_id", "th", "start", "strings", F.lit(None).cast("binary").alias("marks"))

    # one of each kind of run stands for it; first() takes all its columns from one row
    unsettled = again.where("not settled")
    kinds = unsettled.groupBy("anchor", "hash").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("doc_id", "th", "start", "strings", "place")])
    kinds = cut(kinds)
    release(spark)
    crowded = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > crowd).select(F.col("anchor").alias("known"))
    flagged = kinds.join(crowded, F.col("anchor") == F.col("known"), "left").withColumn("crowd", F.col("known").isNotNull()).drop("known")
    wanted = flagged.groupBy("doc_id", "th").agg(F.collect_list(F.struct("anchor", "hash", "n", "start", "strings", "place", "crowd")).alias("wanted"))
    wanted = wanted.select(F.col("doc_id").alias("w_id"), F.col("th").alias("w_th"), "wanted")
    held = keyed.join(wanted, same(keyed, wanted, [("doc_id", "w_id"), ("th", "w_th")])).select("text", "wanted")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "hash", "n", "strings", "place", "crowd", "bytes"]
        for batch in batches:
            rows = []
            for text, own in zip(batch.column("text"), batch.column("wanted")):
                data = text.as_py().encode("utf-8", "surrogatepass")
                rows += [(w["anchor"], w["hash"], w["n"], w["strings"], w["place"], w["crowd"], data[w["start"] : w["start"] + w["strings"] - 1 + length]) for w in own.as_py()]
                if len(rows) > 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=names)

    segments = cut(held.mapInArrow(fetch, "anchor long, hash long, n long, strings long, place long, crowd boolean, bytes binary"))
    release(spark)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        anchor, digest = table.column("anchor").to_numpy(), table.column("hash").to_numpy()
        order = np.lexsort((digest, anchor))
        once = np.append(True, (anchor[order][1:] != anchor[order][:-1]) | (digest[order][1:] != digest[order][:-1]))
        order = order[once]  # a document that is there twice sends its runs twice
        edges = np.flatnonzero(np.append(True, anchor[order][1:] != anchor[order][:-1])).tolist()
        at = 0
        while at < len(edges):  # some whole anchors at a time
            stop = at + 1
            while stop < len(edges) and edges[stop] - edges[at] < 4096:
                stop += 1
            part = order[edges[at] : edges[stop] if stop < len(edges) else len(order)]
            some = table.take(pa.array(part))
            marks = repeated_strings(some.column("bytes").to_pylist(), some.column("place").to_numpy(), some.column("strings").to_numpy(), anchor[part], length, step)
            keep = [k for k, x in enumerate(marks) if x.any()]
            packed = pa.array([np.packbits(marks[k]).tobytes() for k in keep], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(anchor[part][keep]), pa.array(digest[part][keep]), packed], names=["anchor", "hash", "marks"])
            at = stop

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data, m = np.frombuffer(batch.column("bytes")[k].as_py(), np.uint8), batch.column("strings")[k].as_py()
                j = np.arange(m)
                a, b = (Hashes(data, base).of(j, j + length).view(np.int64) for base in _BASES)
                same_ = [pa.array(np.full(m, batch.column(c)[k].as_py())) for c in ("anchor", "hash")]
                yield pa.RecordBatch.from_arrays([*same_, pa.array(j), pa.array(a), pa.array(b)], names=["anchor", "hash", "j", "a", "b"])

    calm = segments.where("not crowd").repartition("anchor").mapInArrow(resolve, "anchor long, hash long, marks binary")
    each = segments.where("crowd").dropDuplicates(["anchor", "hash"]).mapInArrow(single, "anchor long, hash long, j long, a long, b long")
    several = each.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("a").alias("a2"), F.col("b").alias("b2"))
    hits = each.join(several, (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")))
    bits = hits.groupBy("anchor", "hash").agg(F.collect_list("j").alias("js"))  # of one run

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for js in batch.column("js"):
                row = np.zeros(length, bool)
                row[js.as_py()] = True
                out.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("anchor"), batch.column("hash"), pa.array(out, pa.binary())], names=["anchor", "hash", "marks"])

    crowds = bits.mapInArrow(pack, "anchor long, hash long, marks binary")
    copies = kinds.where("n > 1").select("anchor", "hash", F.lit(None).cast("binary").alias("marks"))
    alone = kinds.where("n = 1").select(F.col("anchor").alias("k_anchor"), F.col("hash").alias("k_hash"))
    marked = calm.union(crowds)
    marked = marked.join(alone, (F.col("anchor") == F.col("k_anchor")) & (F.col("hash") == F.col("k_hash"))).select("anchor", "hash", "marks")
    answers = cut(marked.union(copies).select(F.col("anchor").alias("r_anchor"), F.col("hash").alias("r_hash"), "marks"))
    release(spark)
    judged = unsettled.join(answers, (F.col("anchor") == F.col("r_anchor")) & (F.col("hash") == F.col("r_hash")))
    return settled.union(judged.select("doc_id", "th", "start", "strings", "marks"))


def covered(text: bytes, own: list[dict], length: int = LENGTH) -> np.ndarray:
    """Which bytes of a text lie in a repeated string."""
    step = np.zeros(len(text) + 1, np.int64)
    for r in own:
        js = np.arange(r["strings"]) if r["marks"] is None else np.flatnonzero(np.unpackbits(np.frombuffer(r["marks"], np.uint8))[: r["strings"]])
        np.add.at(step, r["start"] + js, 1)
        np.add.at(step, r["start"] + js + length, -1)
    return np.cumsum(step[:-1]) > 0


def dedup(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that are left) of every row.

    Null texts count as empty; texts shorter than the strings lose nothing. Rows that repeat doc_id and text are
    documents of their own, hence repeat each other's strings. A null doc_id is kept; an empty table gives an empty
    result; other columns play no part.
    """
    found = spans(docs, length, **options)
    by_text = found.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "strings", "marks")).alias("own"))
    by_text = by_text.select(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th"), "own")
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    joined = keyed.join(by_text, same(keyed, by_text, [("doc_id", "s_id"), ("th", "s_th")]), "left").select("doc_id", "text", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, own in zip(batch.column("text"), batch.column("own")):
                data, own = text.as_py().encode("utf-8", "surrogatepass"), own.as_py()
                if not own:
                    out.append((len(data), 0, 0, hashlib.sha256(data).hexdigest(), data))
                    continue
                gone = covered(data, own, length)
                left = np.frombuffer(data, np.uint8)[~gone].tobytes()
                n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(data), int(gone.sum()), n_spans, hashlib.sha256(left).hexdigest(), left))
            columns = [pa.array(list(c)) for c in zip(*out)] if out else [pa.array([], pa.null())] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
