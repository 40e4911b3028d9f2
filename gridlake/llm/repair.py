"""Token ids in files compressed by Re-Pair grammars, one grammar a shard.

A shard holds whole documents in order. Frequent pairs of neighbouring symbols are repeatedly replaced by nonterminals,
many pairs a round, left to right; a pair never crosses the end of a document, so each document is a run of symbols of
its own. The file keeps the rules with their expansion lengths, the symbols, and for each document where its symbols
begin and how many ids they stand for: any document, or any stretch of ids in it, decodes without the others.

Symbols are numbered densely: first the ids that the shard uses, then its nonterminals. Layout, little-endian: ``RPR2``,
then unsigned 32-bit numbers of documents, symbols, rules and ids used; the ids used (unsigned 32-bit); per document id
(signed 64-bit), whether the id is null (one byte), end in the symbols and number of ids (unsigned 32-bit); the rules'
left and right symbols; their expansion lengths (unsigned 32-bit); the symbols. Symbols are written as their low 16 bits,
then one packed bit plane for each bit above that the largest needs. Shards are rows of a Parquet dataset, which any
file system of Spark's can hold and whose commit survives lost tasks: shard (partition * 2 ** 32 + number), n_docs,
n_ids, payload.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import ROWS, encoder
from .common import new_path

#: Ids of a shard; least counts of a pair that is replaced, frequent pairs first. The last is where a rule (8 bytes) pays.
SHARD_IDS, LEAST = 1 << 21, (512, 64, 8)
MAGIC = b"RPR2"
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Added to the last symbol of a document while pairs are replaced.
_LAST = np.uint32(1 << 31)


def _frequent(code: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs that occur ``least`` or more times in ``code``, in order; those of the places ``at``; which pair is at each).

    Pairs are counted by digests of up to 20 bits first; only pairs whose digest is frequent are counted one by one. The
    pair that was seen last with a digest is counted by it; only pairs that share a digest with another one are sorted.
    """
    bits = min(20, max(8, (16 * len(code) // least).bit_length()))
    digest = ((code * _SPREAD) >> np.uint64(64 - bits)).astype(np.intp)
    many = np.flatnonzero(np.bincount(digest, minlength=1 << bits) >= least)
    slots = np.full(1 << bits, -1, np.int32)
    slots[many] = np.arange(len(many))
    slot = slots.take(digest)
    likely = np.flatnonzero(slot >= 0)
    code, slot = code.take(likely), slot.take(likely).astype(np.intp)
    held = np.zeros(len(many), np.uint64)
    held[slot] = code
    rest = np.flatnonzero(held.take(slot) != code)
    more, which = np.unique(code.take(rest), return_inverse=True)
    slot[rest] = len(many) + which
    found = np.flatnonzero(np.bincount(slot, minlength=len(many) + len(more)) >= least)
    pairs = np.concatenate([held, more])[found]
    order = np.argsort(pairs)
    number = np.full(len(many) + len(more), -1)
    number[found[order]] = np.arange(len(found))
    which = number.take(slot)
    hit = np.flatnonzero(which >= 0)
    return pairs[order], at.take(likely.take(hit)), which.take(hit)


def compress(ids: np.ndarray, ends: np.ndarray, least: tuple[int, ...] = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, ends of the documents in them, rules, ids used); ``ends``: of the documents in ``ids``.

    For each count in ``least`` rounds go on until no pair occurs so often. A round replaces all pairs that do, so that
    in the next one only pairs with a symbol made just now can have become as frequent, and only those are counted.
    """
    used = np.flatnonzero(np.bincount(ids)) if len(ids) else np.zeros(0, np.int64)
    dense = np.zeros(int(used[-1]) + 1 if len(used) else 0, np.uint32)
    dense[used] = np.arange(len(used))
    seq, made = dense[ids], len(used)
    seq[ends[ends > 0] - 1] |= _LAST
    rules: list[np.ndarray] = []
    for count in least:
        fresh: np.ndarray | None = None  # where the symbols stand that the round before made
        while len(seq) > 1:
            if fresh is None:
                at = np.flatnonzero(seq[:-1] < _LAST)
            else:  # pairs that begin before or at such a symbol
                at = np.stack([fresh - 1, fresh], axis=1).ravel()
                at = at[(np.diff(at, prepend=-1) > 0) & (at < len(seq) - 1)]
                at = at[seq.take(at) < _LAST]
            code = (seq.take(at).astype(np.uint64) << np.uint64(32)) | (seq.take(at + 1) & ~_LAST)
            pairs, at, which = _frequent(code, at, count)
            if not len(pairs):
                break
            # of pairs that overlap in a run every second one is replaced, from the left
            head = np.ones(len(at), bool)
            head[1:] = np.diff(at) != 1
            even = np.flatnonzero((np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))) & 1 == 0)
            at, which = at.take(even), which.take(even)
            uses = np.bincount(which, minlength=len(pairs)) > 0  # what others overlap everywhere gets no rule
            pairs = pairs[uses]
            seq[at] = (made + np.cumsum(uses) - 1).astype(np.uint32).take(which) | (seq.take(at + 1) & _LAST)
            stays = np.ones(len(seq), bool)
            stays[at + 1] = False
            seq, fresh = seq[stays], at - np.arange(len(at))
            rules.append(np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
            made += len(pairs)
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    stops = np.zeros(len(ends), np.int64)
    stops[np.diff(ends, prepend=0) > 0] = np.flatnonzero(seq >= _LAST) + 1
    return seq & ~_LAST, np.maximum.accumulate(stops) if len(stops) else stops, table, used


def _high_bits(symbols: int) -> int:
    """Bits above 16 that numbers below ``symbols`` need."""
    return max(0, (symbols - 1).bit_length() - 16)


def _planes(numbers: np.ndarray, bits: int) -> bytes:
    """Low 16 bits of all numbers, then a packed plane for each of ``bits`` higher ones."""
    high = [np.packbits((numbers >> np.uint32(16 + k) & np.uint32(1)).astype(bool)).tobytes() for k in range(bits)]
    return b"".join([(numbers & np.uint32(0xFFFF)).astype("<u2").tobytes(), *high])


def pack(doc_ids: list, documents: list[np.ndarray], least: tuple[int, ...] = LEAST) -> bytes:
    """A shard of whole documents."""
    lengths = np.array([len(d) for d in documents], np.int64)
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    seq, stops, rules, used = compress(ids, np.cumsum(lengths), least)
    size = [1] * len(used)
    for a, b in rules.tolist():
        size.append(size[a] + size[b])
    head = np.array([len(documents), len(seq), len(rules), len(used)], "<u4").tobytes()
    numbers = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids)
    bits = _high_bits(len(size))
    grammar = [_planes(rules[:, 0], bits), _planes(rules[:, 1], bits), np.array(size[len(used) :], "<u4").tobytes()]
    return b"".join([MAGIC, head, used.astype("<u4").tobytes(), numbers, stops.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), *grammar, _planes(seq, bits)])


class Shard:
    """A packed shard, opened for reading."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a shard")
        n, symbols, rules, n_used = np.frombuffer(payload, "<u4", 4, 4).tolist()
        at, bits = 20, _high_bits(n_used + rules)

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            begin, at = at, at + np.dtype(kind).itemsize * count
            return np.frombuffer(payload, kind, count, begin)

        def planes(count: int) -> np.ndarray:
            out = take("<u2", count).astype(np.uint32)
            for k in range(bits):
                out |= np.unpackbits(take("u1", -(-count // 8)), count=count).astype(np.uint32) << np.uint32(16 + k)
            return out

        self.used = take("<u4", n_used)
        numbers, nulls = take("<i8", n), take("u1", n)
        self.doc_ids = [None if z else d for d, z in zip(numbers.tolist(), nulls.tolist())]
        self.stops, self.lengths = take("<u4", n).astype(np.int64), take("<u4", n).astype(np.int64)
        self.rules = np.stack([planes(rules), planes(rules)], axis=1)
        self.sizes = take("<u4", rules).astype(np.int64)
        self.symbols = planes(symbols)
        self._table: tuple | None = None

    def _expansions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all expansions, where each symbol's begins, its length)."""
        if self._table is None:
            first = len(self.used)
            room = np.concatenate([self.used.astype(np.uint32), np.zeros(int(self.sizes.sum()), np.uint32)])
            length = np.concatenate([np.ones(first, np.int64), self.sizes])
            start = np.concatenate([np.arange(first), first + np.cumsum(self.sizes) - self.sizes]).astype(np.int64)
            begin, size = start.tolist(), length.tolist()
            for k, (a, b) in enumerate(self.rules.tolist(), first):
                p, m = begin[k], begin[k] + size[a]
                room[p:m] = room[begin[a] : begin[a] + size[a]]
                room[m : p + size[k]] = room[begin[b] : begin[b] + size[b]]
            self._table = room, start, length
        return self._table

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        room, start, length = self._expansions()
        n = length[symbols]
        ends = np.cumsum(n)
        return room[np.repeat(start[symbols] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def document(self, k: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids ``first`` up to ``last`` of the k-th document; only the symbols that cover them are expanded."""
        own = self.symbols[self.stops[k - 1] if k else 0 : self.stops[k]]
        last = int(self.lengths[k]) if last is None else min(last, int(self.lengths[k]))
        if first >= last:
            return np.zeros(0, np.uint32)
        ends = np.cumsum(self._expansions()[2][own])
        a, b = np.searchsorted(ends, first, "right"), np.searchsorted(ends, last, "left") + 1
        skip = int(ends[a - 1]) if a else 0
        return self._expand(own[a:b])[first - skip : last - skip]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Every document's id and ids, expanded some thousand symbols at a time."""
        k, n = 0, len(self.doc_ids)
        while k < n:
            begin, stop = int(self.stops[k - 1]) if k else 0, k + 1
            while stop < n and self.stops[stop] - begin < 1 << 17:
                stop += 1
            ids = self._expand(self.symbols[begin : self.stops[stop - 1]])
            ends = np.cumsum(self.lengths[k:stop])
            for d, a, b in zip(self.doc_ids[k:stop], (ends - self.lengths[k:stop]).tolist(), ends.tolist()):
                yield d, ids[a:b]
            k = stop


def write(docs: DataFrame, path: str, model: str, end_id: int = 0, shard_ids: int = SHARD_IDS) -> None:
    """Encode ``docs`` in ascending doc_id order (null ids first), append ``end_id`` to each and write shards to ``path``.

    Ids are those of the library as loaded: the model's added tokens in a text are their own ids. Null texts count as
    empty: the end id alone. doc_id is an integer. Documents that share a doc_id, or have none, follow each other in
    the order of a digest of their text, and may fill several partitions. Other columns are not read; an empty table
    writes a dataset without shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, number = encoder("library", model), TaskContext.get().partitionId(), 0
        doc_ids, documents, size = [], [], 0
        end = np.array([end_id], np.uint32)

        def shard():
            row = [(part << 32) + number], [len(documents)], [size], [pack(doc_ids, documents)]
            return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), pa.array(row[1], pa.int64()), pa.array(row[2], pa.int64()), pa.array(row[3], pa.binary())], names=["shard", "n_docs", "n_ids", "payload"])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                texts = [t or "" for t in some.column("text").to_pylist()]
                for d, ids in zip(some.column("doc_id").to_pylist(), coder.encode_with_added(texts)):
                    doc_ids.append(d)
                    documents.append(np.concatenate([ids, end]))
                    size += len(ids) + 1
                    if size >= shard_ids:
                        yield shard()
                        doc_ids, documents, size, number = [], [], 0, number + 1
        if documents:
            yield shard()

    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", digest).sortWithinPartitions("doc_id", digest)
    ordered.mapInArrow(run, "shard long, n_docs long, n_ids long, payload binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the shards in ``path``: doc_id, start, n_tokens, ids_crc32; start counts over all shards."""
    shards = spark.read.parquet(path)
    sizes = shards.select("shard", F.shiftright("shard", 32).alias("part"), "n_ids")
    totals = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    ahead = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))  # a row a partition
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    starts = sizes.withColumn("inside", inside).join(ahead, "part").select("shard", (F.col("ahead") + F.col("inside")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column("shard").to_pylist(), batch.column("payload")):
                rows, at = [], 0
                for d, ids in Shard(payload.as_buffer().to_pybytes()).documents():
                    rows.append((number, d, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                columns = [pa.array(list(c), pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = shards.select("shard", "payload").mapInArrow(run, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, "shard").select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, model: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` as shards into the shared folder and read them back."""
    spark = docs.sparkSession
    path = new_path(spark, "repair")
    write(docs, path, model, end_id)
    return read(spark, path)
