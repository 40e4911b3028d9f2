"""Near duplicates by the Jaccard similarity of word shingles, with candidates found completely by prefix filtering.

Two sets of n shingles that are similar enough share at least a = ceil(n * similarity) of them, so whatever total order
shingles have, the first n - a + 1 of both have one in common: each text emits that prefix only, and what meets in a
shingle is a candidate. Any order is right; shingles that a sample finds in many texts come last, so that common lines
seldom meet. In a shingle, texts are first compared with the least one, which takes the members of large groups of copies
out without pairing them with each other; it has then met all others there and leaves the shingle. The texts that stay
after that are compared pair by pair, but where they can be similar only: how many of its prefix's shingles a text
shares with any other bounds what it shares with one (what is beyond the prefix of the text that ends first is not
counted), and the first shingle that two share has all the others behind it in both, in an order in which those of few
texts come first. So frequent shingles, being last, make no candidates. Every candidate is verified by its shingles.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .bpe import ROWS
from .common import cut, new_path, release, same, without_rows

#: Words of a shingle, seed of its hash, least similarity as a fraction.
WORDS, SEED, PART, WHOLE = 5, 42, 4, 5
#: Rounds of comparing with the least text of a shingle before the rest is compared pair by pair.
ROUNDS = 1
#: Candidates whose ids are broadcast at most (two ids and two digests each, so 32 MB).
BROADCAST = 1 << 20
#: 64-bit words of a sketch.
SKETCH = 8
#: Texts of the sample, its texts that make a shingle common, most common shingles kept. They affect speed only.
SAMPLE, COMMON, MOST = 50_000, 4, 1 << 18


def shingles(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the shingles; a text with fewer words is one shingle, one without words too."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes, as in the fingerprints
    if len(w) < words:
        w, words = [b" ".join(w)], 1
    n = len(w) - words + 1
    joined = w if words == 1 else map(b" ".join, zip(*(w[i:] for i in range(words))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(seed)), np.uint64, n))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if PART * max(len(a), len(b)) > WHOLE * min(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    met = int(np.count_nonzero(both[1:] == both[:-1]))
    return WHOLE * met >= PART * (len(a) + len(b) - met)


def common_shingles(keyed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ascending hashes of shingles that many texts of a sample have, the place of each by frequency, from 1); the most
    frequent ones if there are too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                found = [shingles(t.as_py()).view(np.int64) for t in batch.column("text").slice(at, ROWS)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["shingle"])

    n = keyed.count()
    some = keyed if n <= SAMPLE else keyed.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < F.lit((SAMPLE << 30) // n))
    counted = some.select("text").mapInArrow(run, "shingle long").groupBy("shingle").count()
    rows = counted.where(F.col("count") >= COMMON).orderBy(F.desc("count"), "shingle").limit(MOST).toArrow()
    found = rows.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(found)
    return found[order], (len(found) - order).astype(np.int32)


def prefixes(keyed: DataFrame, common: Broadcast) -> DataFrame:
    """(shingle, doc_id, h, n) for the shingles of each text's prefix; n: shingles of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = np.append(common.value[0], np.uint64(2**64 - 1)), common.value[1]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                sizes, found = [], []
                for t in some.column("text"):
                    s = shingles(t.as_py())
                    spot = np.searchsorted(known[:-1], s)
                    late = known[spot] == s
                    late[spot == len(place)] = False
                    frequent = np.argsort(place[spot[late]], kind="stable")  # the rarest of the frequent ones first
                    ordered = np.concatenate([s[~late], s[late][frequent]])
                    sizes.append(len(s))
                    found.append(ordered[: len(s) + 1 - -(-len(s) * PART // WHOLE)].view(np.int64))
                row = np.repeat(np.arange(len(found)), [len(f) for f in found])
                taken = some.select(["doc_id", "h"]).take(pa.array(row))
                columns = [pa.array(np.concatenate(found)), *taken.columns, pa.array(np.array(sizes, np.int32)[row])]
                yield pa.RecordBatch.from_arrays(columns, names=["shingle", "doc_id", "h", "n"])

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"shingle long, doc_id {kind}, h long, n int")


def _met(rows: DataFrame) -> DataFrame:
    """``rows`` of shingles that several have, with r (such rows of the text), p (the row's place among them, shingles of
    fewer texts first), the rank k in the shingle, and the least one's doc_id, h, n and r."""
    here, own = Window.partitionBy("shingle"), Window.partitionBy("doc_id", "h")
    shared = rows.select("shingle", "doc_id", "h", "n", F.count(F.lit(1)).over(here).alias("texts")).where("texts > 1")
    placed = F.row_number().over(own.orderBy("texts", "shingle"))
    counted = shared.select("shingle", "doc_id", "h", "n", F.count(F.lit(1)).over(own).cast("int").alias("r"), placed.alias("p"))
    order = here.orderBy(F.col("doc_id").asc_nulls_last(), "h")
    least = [F.first(c).over(order).alias(f"{c}0") for c in ("doc_id", "h", "n", "r")]
    return counted.select("shingle", "doc_id", "h", "n", "r", "p", F.row_number().over(order).alias("k"), *least)


def _stored(frame: DataFrame) -> DataFrame:
    """As cut() does, in columns that are compressed."""
    path = new_path(frame.sparkSession, "near-dedup")
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


#: A text of n shingles has n - BEYOND in its prefix; two of n and n0 that are similar have NEEDED in common at least.
BEYOND = f"(({PART} * greatest(n, n0) + {WHOLE - 1}) div {WHOLE} - 1)"
NEEDED = f"(({PART} * (n + n0) + {PART + WHOLE - 1}) div {PART + WHOLE})"
#: What two texts that meet must fulfil to be similar: sizes that allow it, rows enough to share, and not one text.
POSSIBLE = f"{WHOLE} * least(n, n0) >= {PART} * greatest(n, n0) and least(r, r0) + {BEYOND} >= {NEEDED} and (h <> h0 or not doc_id <=> doc_id0)"
#: What the first shingle that they share fulfils besides: enough rows behind it.
FIRST = f"least(r - p, r0 - p0) + 1 + {BEYOND} >= {NEEDED}"


#: What the sketches of similar texts fulfil: they share at least 4/9 of n + n0, so 1/9 of it is in one only.
CLOSE = f"{PART + WHOLE} * ({' + '.join(f'bit_count(b{k} ^ b{k}0)' for k in range(SKETCH))}) <= {WHOLE - PART} * (n + n0)"


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The parity of the shingles in each of 64 * SKETCH slots, as SKETCH numbers."""
    slots = (shingles >> np.uint64(32)).astype(np.int64) % (64 * SKETCH)
    return np.packbits((np.bincount(slots, minlength=64 * SKETCH) & 1).astype(bool)).view(np.int64)


def _sketched(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """``rows`` with the sketches of their texts, b0, b1 and so on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((batch.num_rows, SKETCH), np.int64)
            for row, t in enumerate(batch.column("text")):
                found[row] = sketch(shingles(t.as_py()))
            columns = [*batch.select(["doc_id", "h"]).columns, *[pa.array(np.ascontiguousarray(c)) for c in found.T]]
            yield pa.RecordBatch.from_arrays(columns, names=["d", "t", *names])

    names = [f"b{k}" for k in range(SKETCH)]
    needed = rows.select(F.col("doc_id").alias("d"), F.col("h").alias("t")).distinct()
    if needed.count() <= BROADCAST:  # else the texts would have to be shuffled
        keyed = keyed.join(F.broadcast(needed), same(keyed, needed, [("doc_id", "d"), ("h", "t")]), "left_semi")
    kind = keyed.schema["doc_id"].dataType.simpleString()
    sketches = keyed.mapInArrow(run, f"d {kind}, t long, " + ", ".join(f"{b} long" for b in names)).dropDuplicates(["d", "t"])
    return rows.join(sketches, same(rows, sketches, [("doc_id", "d"), ("h", "t")])).drop("d", "t")


def _similar_pairs(near: DataFrame, keyed: DataFrame) -> DataFrame:
    """(doc_id, h) of those ``near`` pairs (doc_id, h, doc_id0, h0) whose texts are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = functools.lru_cache(64)(shingles)
        for batch in batches:
            holds = [similar(shingles(a.as_py()), kept(b.as_py())) for a, b in zip(batch.column("text"), batch.column("text0"))]
            yield batch.select(["doc_id", "h"]).filter(pa.array(holds, pa.bool_()))

    near = _stored(near)
    # only texts of candidates move: their ids go to the texts if they are few, else both meet in a shuffle
    needed = near.select(F.col("doc_id").alias("d"), F.col("h").alias("t")).union(near.select("doc_id0", "h0")).distinct()
    needed = F.broadcast(needed) if near.count() <= BROADCAST else needed
    some = _stored(keyed.join(needed, same(keyed, needed, [("doc_id", "d"), ("h", "t")]), "left_semi"))
    texts = some.select(F.col("doc_id").alias("d"), F.col("h").alias("t"), "text")
    firsts = some.select(F.col("doc_id").alias("d0"), F.col("h").alias("t0"), F.col("text").alias("text0"))
    joined = near.join(texts, same(near, texts, [("doc_id", "d"), ("h", "t")])).drop("d", "t")
    joined = joined.join(firsts, same(joined, firsts, [("doc_id0", "d0"), ("h0", "t0")]))
    kind = keyed.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "h", "text", "text0").mapInArrow(run, f"doc_id {kind}, h long").distinct()


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    away = gone.select(F.col("doc_id").alias("d"), F.col("h").alias("t"))
    return rows.join(away, same(rows, away, [("doc_id", "d"), ("h", "t")]), "left_anti")


def linked_copies(docs: DataFrame, keyed: DataFrame) -> DataFrame:
    """(doc_id, h) of rows that ball hashing puts into a component whose least row they are similar to."""
    found = simhash.near_duplicates(docs).select("component_id", "doc_id", F.col("text_xxh64").alias("h"))
    found = _stored(found.distinct())
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    many = found.groupBy("component_id").agg(F.min(order).alias("top"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    tops = many.select(F.col("component_id").alias("c"), F.col("top.doc_id").alias("doc_id0"), F.col("top.h").alias("h0"))
    pairs = found.join(tops, same(found, tops, [("component_id", "c")])).where("h <> h0 or not doc_id <=> doc_id0")
    return cut(_similar_pairs(pairs.select("doc_id", "h", "doc_id0", "h0"), keyed))


def near_copies(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, h) of rows that go: each is similar to a row with a lesser (doc_id, text digest), null ids last.

    No two of the rows that stay are similar.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    gone = [linked_copies(docs, keyed)]
    release(spark)
    common = spark.sparkContext.broadcast(common_shingles(keyed))
    release(spark)
    rows = prefixes(keyed, common)
    linked = gone[0].select(F.col("doc_id").alias("d"), F.col("h").alias("t"))
    linked = F.broadcast(linked) if gone[0].count() <= BROADCAST else linked
    rows = rows.join(linked, same(rows, linked, [("doc_id", "d"), ("h", "t")]), "left_anti")
    met = _stored(_met(rows))
    for _ in range(rounds):
        release(spark)
        # each text against the least one of its shingles, which has then met all others there
        pairs = met.where(f"k > 1 and {POSSIBLE}").select("doc_id", "h", "doc_id0", "h0").distinct()
        gone.append(cut(_similar_pairs(pairs, keyed)))
        met = _stored(_met(_without(met.where("k > 1").select("shingle", "doc_id", "h", "n"), gone[-1])))
    release(spark)
    met = _stored(_sketched(met.select("shingle", "doc_id", "h", "n", "r", "p", "k"), keyed))
    least = met.select("shingle", *[F.col(c).alias(f"{c}0") for c in met.columns if c != "shingle"])
    pairs = met.join(least, "shingle").where(f"k0 < k and {POSSIBLE} and {FIRST} and {CLOSE}")
    near = pairs.select("doc_id", "h", "doc_id0", "h0").distinct()
    gone.append(cut(_similar_pairs(near, keyed)))
    return functools.reduce(DataFrame.union, gone).distinct()


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies; of similar rows that with the least doc_id, then text digest, stays.

    Null texts count as empty, and texts without words are alike. Of rows with one doc_id and text one stays. A row may go
    for one that goes itself, so a chain of similar texts keeps its least one. An empty table gives an empty result.
    """
    keys = {"doc_id": F.col("doc_id"), "h": F.xxhash64(F.coalesce("text", F.lit("")))}
    return without_rows(docs, keys, near_copies(docs))
