import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lithograph.llm.bpe import encode_decode, word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
REAL = Tokenizer.from_file(PATH)
REAL.no_truncation()
REAL.no_padding()
MINE = word_bpe(PATH)


def _same(texts):
    for text, (n, raw, decoded) in zip(texts, MINE.block(texts)):
        ids = REAL.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(raw, "<u4").tolist() == ids, text
        assert n == len(ids)
        assert decoded == REAL.decode(ids, skip_special_tokens=False)


def test_odd_texts():
    _same(["", " ", "Hello WORLD's  aaaa aaaaaaa", "ÉCLAIR é É ΣΑΣ ς İstanbul ﬁ ǅ", "x y\x85z\x1cq w​v", "<|endoftext|>abc <|startoftext|>", "日本語 🙂🙂👩‍👩‍👧 ½ ²³ ٣", "_a_b__ --- don't I'LL", "a" * 3000, "\x00\x01"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(texts):
    _same(texts)


def test_table(spark):
    rows = [(1, "One two two", "x"), (2, None, "y"), (3, "", "z"), (1, "One two two", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k string")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_decode(docs, PATH, digests=True).collect()}
    ids = np.array(REAL.encode("One two two", add_special_tokens=False).ids, "<u4")
    empty = hashlib.sha256(b"").hexdigest()
    assert (1, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(REAL.decode(ids.tolist(), skip_special_tokens=False).encode()).hexdigest()) in got
    assert (2, 0, empty, empty) in got and (3, 0, empty, empty) in got
    assert encode_decode(docs, PATH).where("doc_id = 1").count() == 2
    assert encode_decode(docs.limit(0), PATH).count() == 0
