"""Re-Pair grammars: exact round trips, carried through to the least count, symbols of more than 16 bits."""

from collections import Counter

import numpy as np
import pytest

from gridlake.llm import repair

draw = np.random.default_rng(3)
SHARDS = {
    "one symbol": [np.full(5001, 7, np.uint32), np.zeros(0, np.uint32), np.full(3, 7, np.uint32)],
    "two symbols": [draw.integers(0, 2, n).astype(np.uint32) for n in (4000, 1, 0, 777)],
    "copies": [np.arange(500, dtype=np.uint32)] * 40,
    "skewed": [np.minimum(draw.zipf(1.4, n), 50_256).astype(np.uint32) for n in (30_000, 200, 9_000)],
    "many ids": [draw.integers(0, 150_000, 120_000).astype(np.uint32)] * 9,
}


@pytest.mark.parametrize("name", SHARDS)
def test_round_trip_and_no_frequent_pair_left(name):
    documents = SHARDS[name]
    ids, ends = np.concatenate(documents), np.cumsum([len(d) for d in documents])
    symbols, stops, rules, used = repair.compress(ids, ends)
    pieces = np.split(symbols, stops[:-1])
    seen = Counter(pair for p in pieces for pair in zip(p[:-1].tolist(), p[1:].tolist()))
    assert max(seen.values(), default=0) < repair.LEAST[-1]
    packed = repair.pack(list(range(len(documents))), documents)
    shard = repair.Shard(packed)
    assert [d.tolist() for _, d in shard.documents()] == [d.tolist() for d in documents]
    middle = documents[0]
    assert shard.document(0, 5, 2500).tolist() == middle[5:2500].tolist()


def test_symbols_beyond_16_bits_and_ratio():
    packed = repair.pack(list(range(9)), SHARDS["many ids"])
    shard = repair.Shard(packed)
    assert len(shard.used) + len(shard.rules) > 1 << 16
    assert len(packed) < 0.6 * 4 * 9 * 120_000
    copies = repair.pack(list(range(40)), SHARDS["copies"])
    assert len(copies) < 0.3 * 2 * 40 * 500
