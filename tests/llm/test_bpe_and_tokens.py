"""Byte-level BPE, token files and token counts, against the libraries themselves."""

import base64
import hashlib
import random
import unicodedata
import zlib

import numpy as np
import pytest
import regex
import tiktoken
from public_tokenizers import PATTERN, path
from tokenizers import Tokenizer

from gridlake.llm import bpe, queries, repair, token_counts

RANKS, LIBRARY = path(queries.RANKS), path(queries.LIBRARY)
HARD = ["", " ", "\n\n x", "don't I'll 'tis ''s 's's", "a  b   ", "\u3000\u3000é", "日本語 テスト", "1٣²", "<|endoftext|> !", "x" * 5000, "=-" * 2000, "\r\n\t ", "\U0001f600 \U0001f468\u200d\U0001f469", " 's", "I'LL", "a'"]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    alphabet = ["'", "s", "t", "re", "ll", " ", "  ", "\n", "a", "É", "1", "!", "\u3000", "\U0001f600", "'ve", "'d", "_"]
    return HARD + ["".join(draw.choice(alphabet) for _ in range(draw.randrange(30))) for _ in range(3000)]


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    model = Tokenizer.from_file(LIBRARY)
    model.encode_special_tokens = True
    return lambda t: model.encode(t, add_special_tokens=False).ids


def test_boundaries_are_those_of_the_pattern(texts):
    joined, _, cuts, firsts = bpe.boundaries(texts)
    pieces = [joined[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    pattern = regex.compile(PATTERN)
    for t, a, b in zip(texts, firsts, firsts[1:]):
        assert pieces[a:b] == pattern.findall(t), t


def test_every_codepoint_has_its_class():
    """Of those that Python's Unicode tables know; the pattern's may be newer."""
    table = bpe.class_table()
    for kind, expression in ((bpe.LETTER, r"\p{L}"), (bpe.NUMBER, r"\p{N}")):
        sample = [c for c in range(0, 0x3000) if unicodedata.category(chr(c)) != "Cn"]
        assert {c for c in sample if table[c] == kind} == {c for c in sample if regex.match(expression, chr(c))}


@pytest.mark.parametrize("bits", [4, 21])
def test_ids_are_the_library_s(texts, reference, library, bits):
    """A cache of 16 slots starts anew all the time and gives the same."""
    for merges, wanted in ((bpe.RankMerges(RANKS), reference.encode_ordinary), (bpe.LibraryMerges(LIBRARY), library)):
        coder = bpe.Encoder(merges)
        coder.cache = bpe.PieceCache(merges, bits)
        for _ in range(2):
            for t, (ids, ends) in zip(texts, coder.encode(texts)):
                assert ids.tolist() == wanted(t), t
                assert ends[-1] == len(ids)


def test_round_trip(frame, reference):
    rows = [(1, "Hello  wörld's"), (2, None), (None, ""), (1, "Hello  wörld's")]
    got = bpe.round_trip(frame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_tokens string"), RANKS).collect()
    for (i, t), r in zip(rows, got):
        ids = reference.encode_ordinary(t or "")
        assert (r.doc_id, r.n_tokens) == (i, len(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(frame([], "doc_id long, text string"), RANKS).count() == 0
    coded = bpe.encode_documents(frame(rows[:1], "doc_id long, text string"), RANKS).first()
    ids = np.frombuffer(coded.ids, "<u4")
    tokens = bpe.RankMerges(RANKS).tokens
    assert b"".join(bpe.decode(ids, tokens, a, b) for a, b in zip(coded.offsets, coded.offsets[1:])) == "Hello  wörld's".encode()
    pieces = [bpe.decode(ids, tokens, a, b) for a, b in zip(coded.offsets, coded.offsets[1:])]
    assert pieces == ["Hello".encode(), b" ", " wörld".encode(), b"'s"]


@pytest.mark.parametrize("kind", ["words", "runs", "noise", "empty"])
def test_grammars_expand_to_what_they_stand_for(kind):
    draw = np.random.default_rng(1)
    made = {"words": lambda: draw.choice([5, 7, 7, 9], 4000), "runs": lambda: np.zeros(3000, int), "noise": lambda: draw.integers(0, 50000, 2000), "empty": lambda: np.zeros(0, int)}[kind]
    documents = [np.asarray(made(), np.uint32) for _ in range(3)] + [np.zeros(0, np.uint32), np.array([0], np.uint32)]
    packed = repair.pack([1, None, 3, 4, 5], documents)
    shard = repair.Shard(packed)
    assert [d for d, _ in shard.documents()] == [1, None, 3, 4, 5]
    for k, (_, ids) in enumerate(shard.documents()):
        assert ids.tolist() == documents[k].tolist()
    for k, a, b in ((0, 10, 25), (1, 0, 1), (2, 1999, 5000), (4, 0, 9), (3, 0, 3)):
        assert shard.document(k, a, b).tolist() == documents[k][a:b].tolist()
    if kind in ("words", "runs"):
        assert len(shard.rules) and len(packed) < sum(map(len, documents))


def test_token_files(frame, library):
    rows = [(5, "b c"), (2, "a! !"), (None, None), (2, "zz"), (9, "!" * 300), (7, "")]
    got = repair.token_files(frame(rows, "doc_id long, text string").repartition(3), LIBRARY).collect()
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 2, 2, 5, 7, 9]
    wanted = {(i, tuple([*library(t or ""), 0])) for i, t in rows}
    at = 0
    for r in got:
        match = [ids for i, ids in wanted if i == r.doc_id and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32]
        assert match and r.n_tokens == len(match[0]) and r.start == at
        at += r.n_tokens
    assert repair.token_files(frame([], "doc_id long, text string"), LIBRARY).count() == 0


def test_many_shards(spark, tmp_path, frame):
    rows = [(i, f"word{i % 7} " * (i % 13)) for i in range(200)]
    df = frame(rows, "doc_id long, text string").repartition(4)
    repair.write(df, f"{tmp_path}/s", LIBRARY, shard_ids=100)
    assert spark.read.parquet(f"{tmp_path}/s").count() > 10
    got = sorted(repair.read(spark, f"{tmp_path}/s").collect(), key=lambda r: r.doc_id)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got[:-1]]).tolist()


@pytest.mark.parametrize("block", [3, 7, 1 << 20])
def test_separators_are_stitched_over_blocks(spark, tmp_path, block):
    files = [[1, 2, 9, 9, 3, 9], [5] * 20 + [9, 1], [9], [4, 4]]
    for k, ids in enumerate(files):
        np.array(ids, "<u2").tofile(f"{tmp_path}/part-{k:08d}.ids")
    open(f"{tmp_path}/part-{9:08d}.ids", "w").close()
    got = sorted((r.file, r.ordinal, r.n_tokens, r.ended) for r in token_counts.count_flat(spark, str(tmp_path), 9, block=block).collect())
    assert got == [(0, 0, 2, True), (0, 1, 0, True), (0, 2, 1, True), (1, 0, 20, True), (1, 1, 1, False), (2, 0, 0, True), (3, 0, 2, False)]


def test_token_counts(frame, library):
    rows = [(3, "a b c"), (1, None), (None, "x"), (1, "y y"), (2, "")]
    got = token_counts.token_counts(frame([(*r, 1) for r in rows], "doc_id long, text string, file int"), LIBRARY, queries.END_OF_DOCUMENT).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len(library(t or ""))) for i, t in rows)
    assert token_counts.token_counts(frame([], "doc_id long, text string"), LIBRARY, 50256).count() == 0


def thue_morse(power: int) -> tuple[str, str]:
    """A string of 2 ** power letters and its complement: sums of odd powers modulo 2 ** 64 don't tell them apart."""
    x = "a"
    for _ in range(power):
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("together", [True, False])
@pytest.mark.parametrize("power", [9, 10, 11, 12])
def test_pieces_that_share_a_hash_keep_their_own_ids(reference, library, power, together):
    pair = thue_morse(power)
    same = pair[0][:100] + "c" + pair[0][101:]
    for merges, wanted in ((bpe.RankMerges(RANKS), reference.encode_ordinary), (bpe.LibraryMerges(LIBRARY), library)):
        coder = bpe.Encoder(merges)
        batches = [[*pair, same, pair[0]]] if together else [[pair[0]], [pair[1]], [same], [pair[1]], [pair[0]]]
        for texts in batches:
            for t, (ids, _) in zip(texts, coder.encode(texts)):
                assert ids.tolist() == wanted(t)
                assert not isinstance(merges, bpe.RankMerges) or bpe.decode(ids, merges.tokens).decode() == t
    if power > 9:
        joined, code, at, _ = bpe.boundaries(list(pair))
        assert len(set(coder.cache._hashes(code, at).tolist())) == 1  # so the test is about what it says


def test_a_full_cache_of_codepoints_starts_anew(reference):
    coder = bpe.Encoder(bpe.RankMerges(RANKS))
    coder.cache = bpe.PieceCache(coder.merges, 12, room=64)
    texts = ["some words", "x" * 100, "some words more", "y" * 63, "some"]
    for _ in range(3):
        for t in texts:
            assert next(coder.encode([t]))[0].tolist() == reference.encode_ordinary(t)


@pytest.mark.parametrize("end, kind", [(64, "<u2"), (50256, "u1")])
def test_ids_that_would_give_wrong_counts_are_refused(frame, end, kind):
    """An end id that a text holds ("a" is 64), and ids that the files' numbers can't hold."""
    with pytest.raises(Exception, match="end-of-document id"):
        token_counts.token_counts(frame([(1, "a word")], "doc_id long, text string"), LIBRARY, end, kind).count()
