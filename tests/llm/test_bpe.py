import hashlib
import struct

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from keysieve.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
SMALL = bpe.ChunkEncoder(PATH, bpe.Chunking(4, 2), remembered=50)
COARSE = bpe.ChunkEncoder(PATH, bpe.Chunking(16, 64), remembered=50)
TEXT = st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.,aabcdét0 <|endoftext|>  ñ中🙂"), st.characters(exclude_categories=["Cs"])))


def plain(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(TEXT, st.sampled_from(["a <|endoftext|> b", "<|endoftext|>", " x<|endoftext|>y\n", "don't we'll  it's"])), max_size=6))
def test_same_as_whole_texts(parts):
    texts = ["".join(parts), *parts, " ".join(parts), "\n".join(parts * 20)]
    for encoder in (SMALL, COARSE):
        for text, (ids, decoded) in zip(texts, encoder.encode(texts), strict=True):
            assert bpe.unpacked(ids) == plain(text)
            assert decoded == WHOLE.decode(plain(text), skip_special_tokens=False)


def test_cuts_depend_on_content_alone():
    chunking = bpe.Chunking(8, 16)
    passage = "".join(chr(97 + (i * i) % 26) + (" " if i % 5 == 0 else "") for i in range(400)).encode()
    alone = bpe.cuts(np.frombuffer(passage, dtype=np.uint8), chunking)
    moved = bpe.cuts(np.frombuffer(b"something else " + passage, dtype=np.uint8), chunking) - 15
    assert {c for c in alone.tolist() if c >= 8} == {c for c in moved.tolist() if c >= 8} and len(alone) > 5


def test_long_text_over_blocks(monkeypatch):
    text = "Thatis a line of wörds and sö on, number 7. " * 300 + "x" * 5000 + "\n" * 3000
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    whole = bpe.cuts(raw)
    monkeypatch.setattr(bpe, "BLOCK", 1000)
    assert bpe.cuts(raw).tolist() == whole.tolist()
    assert bpe.unpacked(SMALL.encode([text])[0][0]) == plain(text)


def test_frame(spark, docs):
    rows = [(1, "same text here"), (1, "same text here"), (2, None), (3, ""), (None, "a b"), (4, "longer " * 3000)]
    found = bpe.digests(bpe.encode(docs(rows, extra=True), PATH)).collect()
    want = sorted(
        (str(i), len(plain(t)), hashlib.sha256(struct.pack(f"<{len(plain(t))}I", *plain(t))).hexdigest(),
         hashlib.sha256((t or "").encode()).hexdigest())
        for i, t in rows
    )
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == want
    assert bpe.encode(docs([]), PATH).collect() == []


def test_other_tokenizers_are_refused(docs):
    with pytest.raises(ValueError):
        bpe.encode(docs([]), public_tokenizers.path("word_bpe_49k.json"))
