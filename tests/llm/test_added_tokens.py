"""Token files hold the ids of the tokenizers library as loaded, added tokens included."""

import zlib

import numpy as np
from public_tokenizers import path
from tokenizers import Tokenizer

from gridlake.llm import queries, repair

LIBRARY = path(queries.LIBRARY)
TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n y's", "don'<|endoftext|>t", "<|endoftext| >", "plain  ", "", None]


def test_added_tokens_in_texts(frame):
    model = Tokenizer.from_file(LIBRARY)
    got = repair.token_files(frame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3), LIBRARY).collect()
    at = 0
    for r in sorted(got, key=lambda r: r.doc_id):
        ids = [*model.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), TEXTS[r.doc_id]
        at += len(ids)
    assert at and len(got) == len(TEXTS)
