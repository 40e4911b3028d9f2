"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints that differ in at most 2 bits have a common variant within 1 bit of each: every distinct fingerprint emits
itself and its 64 one-bit variants, the variants are shuffled, and what meets in a variant is a candidate. A variant
holds 65 fingerprints at most, whatever the data, and texts with one fingerprint are one row before anything is
emitted, so no group grows with the number of copies. Inside a variant each fingerprint is linked to the least one;
all members lie within 2 bits of each other, so these links keep every component whole. Links are deduplicated,
verified by counting differing bits, and closed by :mod:`components`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, same, without_rows
from .components import components

#: Words of a shingle, seed of its hash, greatest number of differing bits of a link.
WORDS, SEED, RADIUS = 3, 42, 2
#: Fingerprints of which one task emits the variants, on average.
EMITTED = 1 << 14
#: Shingles hashed at a time, so that a text of any length needs little memory.
BLOCK = 1 << 16


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """64-bit SimHash: a bit is 1 if it is set in over half of the shingles' hashes; 0 for a text without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and the six ASCII separators
    if not w:
        return 0
    if len(w) < words:
        w, words = [b" ".join(w)], 1
    n, ones = len(w) - words + 1, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = w[at : at + BLOCK + words - 1]
        shingles = part if words == 1 else map(b" ".join, zip(*(part[i:] for i in range(words))))
        m = min(BLOCK, n - at)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, m)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(m, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, text_xxh64) of every row; fp is the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), words, seed) for t in batch.column("text")]
            fp = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fp, batch.column("h")], names=["doc_id", "fp", "text_xxh64"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    return slim.mapInArrow(run, f"doc_id {kind}, fp long, text_xxh64 long")


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): for fingerprints ``fp`` within ``radius`` bits, links whose components are those of all such pairs.

    Fingerprints are few bytes but become 65 rows each, so they are dealt out by their number before they do.
    """
    if radius != 2:
        raise ValueError("a variant's members are sure to lie within the radius for radius 2 only")
    tasks = max(1, -(-prints.count() // EMITTED))
    distinct = prints.select("fp").distinct().repartition(tasks, "fp")
    ball = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), i) for i in range(64)])
    variants = distinct.select("fp", F.explode(F.transform(ball, lambda bit: F.col("fp").bitwiseXOR(bit))).alias("variant"))
    met = variants.groupBy("variant").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
    pairs = met.select(F.array_min("fps").alias("v"), F.explode("fps").alias("u")).where("u <> v").distinct()
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)


def near_duplicates(docs: DataFrame, words: int = WORDS, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (least doc_id of the component) and text_xxh64.

    Null texts count as empty; texts without words have fingerprint 0 and are linked like any others. A null doc_id
    never is a component's id unless all its doc_ids are null. Repeated rows are nodes like others; an empty table
    gives an empty result; other columns play no part.
    """
    prints = cut(fingerprints(docs, words, seed))
    closed = components(links(prints, radius))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = least.join(closed, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(ids, "root").select(F.col("fp").alias("node"), "component_id")
    return prints.join(by_print, F.col("fp") == F.col("node")).select("doc_id", "fp", "component_id", "text_xxh64")


def dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` of which one per component stays: that with the least doc_id, then the least text digest."""
    found = cut(near_duplicates(docs, **options))
    stays = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_xxh64")).alias("top"))
    many = stays.select(F.col("component_id").alias("c"), F.col("top.doc_id").alias("top_id"), F.col("top.text_xxh64").alias("top_text"))
    joined = found.join(many, same(found, many, [("component_id", "c")]))
    stay = F.col("doc_id").eqNullSafe(F.col("top_id")) & (F.col("text_xxh64") == F.col("top_text"))
    away = joined.where(~stay).select("doc_id", "text_xxh64")
    keys = {"doc_id": F.col("doc_id"), "text_xxh64": F.xxhash64(F.coalesce("text", F.lit("")))}
    return without_rows(docs, keys, away)
