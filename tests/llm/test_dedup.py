"""Exact, near and substring dedup against brute force."""

import collections
import hashlib
import random

import pytest
import xxhash

from gridlake.llm import components, exact_dedup, simhash, suffix_dedup

ROWS = [(1, "same text", "a"), (2, "same text", "b"), (7, None, "c"), (8, "", "d"), (None, "same text", "e"), (2, "same text", "b"), (9, "Same text", "f"), (None, None, "g"), (4, "x" * 30000, "h"), (5, "x" * 30000, "i")]
SCHEMA = "doc_id long, text string, KEPT string"


def test_exact_groups(frame):
    got = exact_dedup.groups(frame(ROWS, SCHEMA).repartition(3)).collect()
    assert len(got) == len(ROWS)
    for text, keep, size in (("same text", 2, 4), ("", 8, 3), ("Same text", 9, 1), ("x" * 30000, 5, 2)):
        some = [r for r in got if r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()]
        assert len(some) == size and {r.keep_id for r in some} == {keep} and {r.group_size for r in some} == {size}
        assert [r.doc_id for r in some if r.kept] == [keep]
    assert exact_dedup.groups(frame([], SCHEMA)).count() == 0


def test_identifiers_widen_until_they_are_verified(frame):
    from pyspark.sql import functions as F

    rows = [(i, t) for i, t in enumerate(["ab", "cd", "ab", "xyz", "cd"])]
    poor = (lambda c: F.length(c), lambda c: F.substring(c, 1, 1), lambda c: c)
    got = {r.doc_id: r.keep_id for r in exact_dedup.groups(frame(rows, "doc_id long, text string"), identifiers=poor).collect()}
    assert got == {0: 2, 2: 2, 1: 4, 4: 4, 3: 3}


def test_chunks_join_to_the_text_and_follow_content(frame):
    from pyspark.sql import functions as F

    draw = random.Random(2)
    text = "".join(draw.choice("abc \n.é😀") for _ in range(3000))
    rows = frame([(text,), ("zz" + text,), ("",)], "t string").select(exact_dedup.chunks(F.col("t"), 16, 64).alias("c")).collect()
    assert "".join(rows[0].c) == text and rows[2].c == []
    assert len(set(rows[0].c) & set(rows[1].c)) > len(rows[0].c) / 2


def test_exact_dedup_of_rows(frame):
    got = exact_dedup.dedup(frame(ROWS, SCHEMA))
    assert got.columns == ["doc_id", "text", "KEPT"]
    assert sorted((r.doc_id, len(r.text or "")) for r in got.collect()) == [(2, 9), (5, 30000), (8, 0), (9, 9)]


def brute_fingerprint(text):
    b = (text or "").encode()
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    words = [w for w in __import__("re").findall(rb"[^\x20\x09-\x0D]+", b)]
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    draw = random.Random(3)
    for text in [None, "", " \t\n", "one", "One TWO", "É é É", "a\u00a0b c d", *(" ".join(draw.choice("abcDEF\u3000") for _ in range(draw.randrange(60))) for _ in range(50))]:
        assert simhash.fingerprint(text) == brute_fingerprint(text), text
    long = " ".join(str(draw.random()) for _ in range(2000))
    whole, simhash.BLOCK = simhash.BLOCK, 64
    try:
        assert simhash.fingerprint(long) == brute_fingerprint(long)
    finally:
        simhash.BLOCK = whole


def closure(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_links_close_to_all_pairs_within_the_radius(frame):
    draw = random.Random(4)
    prints = []
    for _ in range(12):
        p = draw.getrandbits(63)
        prints.append(p)
        for _ in range(draw.randrange(8)):
            for _ in range(draw.randrange(1, 4)):
                p ^= 1 << draw.randrange(63)
            prints.append(p)
    nodes = sorted(set(prints))
    edges = simhash.links(frame([(p,) for p in prints], "fp long"))
    got = {r.node: r.root for r in components.components(edges).collect()}
    want = closure(nodes, lambda a, b: (a ^ b).bit_count() <= 2)
    assert {n: got.get(n, n) for n in nodes} == want


def test_long_paths_and_no_edges(frame):
    path = [(i, i + 1) for i in range(200)]
    random.Random(1).shuffle(path)
    got = components.components(frame(path + [(5, 5), (1000, 1001), (1001, 1000), (None, 3)], "u long, v long")).collect()
    assert {r.root for r in got if r.node <= 200} == {0} and {r.root for r in got if r.node >= 1000} == {1000} and len(got) == 203
    assert components.components(frame([], "u long, v long")).count() == 0


def test_near_duplicates(frame):
    base = "the quick brown fox jumps over the lazy dog " * 20
    rows = [(5, base), (3, base + "cat"), (9, "entirely different words here"), (None, base), (2, None), (1, ""), (1, ""), (None, "alone in the world")]
    got = simhash.near_duplicates(frame([(*r, 0) for r in rows], "doc_id long, text string, fp int").repartition(2)).collect()
    prints = {t: simhash.fingerprint(t) for _, t in rows}
    for r in got:
        r_print = r.fp % (1 << 64)
        linked = {i for i, t in rows if i is not None and (prints[t] ^ r_print).bit_count() <= 2}
        assert r.component_id == (min(linked) if linked else None)
    stays = simhash.dedup(frame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in stays) == (["1", "3", "9", "None"] if (prints[base] ^ prints[base + "cat"]).bit_count() <= 2 else ["1", "3", "5", "9", "None"])
    assert simhash.near_duplicates(frame([], "doc_id long, text string")).count() == 0


def test_suffix_arrays():
    draw = random.Random(6)
    for _ in range(3000):
        s = [draw.randrange(1, draw.choice([2, 3, 6])) for _ in range(draw.randrange(0, 40))]
        assert suffix_dedup.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute_spans(texts, length):
    count = collections.Counter()
    for t in texts:
        b = (t or "").encode()
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [2000, 1])
def test_substrings(frame, crowd):
    draw = random.Random(7)
    passage = "".join(draw.choice("abcdefgh é") for _ in range(420))
    texts = ["".join(draw.choice("abcdefgh ") for _ in range(draw.randrange(900))) for _ in range(30)]
    for k in range(20):
        a = draw.randrange(150)
        texts.append(texts[k][:50] + passage[a : a + draw.randrange(150, 270)] + texts[k][300:])
    edited = list(texts[3] * 2)
    edited[200] = "#"
    texts += ["".join(edited), "ab" * 400, "a" * 700, "abc" * 70, None, "", "q" * 199, texts[5], texts[5], passage * 2]
    rows = [(i if i % 9 else None, t, 1, "x") for i, t in enumerate(texts)]
    got = suffix_dedup.dedup(frame(rows, "doc_id long, text string, start int, MARKS string").repartition(3), crowd=crowd).collect()
    a = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    b = collections.Counter((r[0], *x) for r, x in zip(rows, brute_spans(texts, 200)))
    assert a == b
    assert suffix_dedup.dedup(frame([], "doc_id long, text string")).count() == 0
