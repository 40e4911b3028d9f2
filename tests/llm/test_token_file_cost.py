"""What makes token files cheap: unseen pieces of any kind go to the library many at a time, pairs are counted unsorted."""

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from gridlake.llm import bpe, queries, repair

LIBRARY = path(queries.LIBRARY)


class Counting:
    """A library model that counts the texts it is given."""

    def __init__(self, model):
        self.model, self.texts = model, 0

    def encode_batch_fast(self, texts, **how):
        self.texts += len(texts)
        return self.model.encode_batch_fast(texts, **how)


@pytest.mark.parametrize("form", ["w{}x", "\n{}", " {}!", "\u00e9{}\t\t", "{}\u65e5 ", "\x00{}\U0001f600"])
def test_unseen_pieces_go_together(form):
    texts = [form.format(i) for i in range(4000)]
    coder = bpe.Encoder(bpe.LibraryMerges(LIBRARY))
    coder.merges.model = counting = Counting(coder.merges.model)
    got = [ids.tolist() for ids, _ in coder.encode(texts)]
    assert got == [e.ids for e in Tokenizer.from_file(LIBRARY).encode_batch(texts, add_special_tokens=False)]
    assert 0 < counting.texts < 100


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 511, 512, 513])
def test_pieces_are_told_apart_where_texts_end(n):
    texts = [f"q{chr(0x4E00 + i)}" for i in range(n - 1)] + ["\u3000"]
    library = Tokenizer.from_file(LIBRARY)
    coder = bpe.Encoder(bpe.LibraryMerges(LIBRARY))
    assert [ids.tolist() for ids, _ in coder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_codepoint_is_the_library_s():
    texts = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x11000), *range(0x1F000, 0x20000))]
    wanted = Tokenizer.from_file(LIBRARY).encode_batch(texts, add_special_tokens=False)
    coder = bpe.Encoder(bpe.LibraryMerges(LIBRARY))
    assert [ids.tolist() for ids, _ in coder.encode(texts)] == [e.ids for e in wanted]


def test_frequent_pairs_are_counted_without_a_sort_of_places(monkeypatch):
    draw = np.random.default_rng(2)
    documents = [np.minimum(draw.zipf(1.3, 50_000), 50_256).astype(np.uint32) for _ in range(6)]
    sorts, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda a, **how: sorts.append(len(a)) or unique(a, **how))
    packed = repair.pack(list(range(6)), documents)
    assert [d.tolist() for _, d in repair.Shard(packed).documents()] == [d.tolist() for d in documents]
    assert sorts and max(sorts) < 0.1 * 6 * 50_000
