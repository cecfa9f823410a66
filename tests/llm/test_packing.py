"""Packing against brute force: subset sums, whole-text encoding, and the rules that sequences must obey."""

import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from keysieve.llm import packing
from keysieve.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
QUICK = packing.Encoder(PATH)


def plain(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


def checked(rows, texts, capacity=1024):
    """Every rule of the operator on collected pieces; texts are ``(key, text)`` pairs."""
    want = Counter((key, tuple([*plain(text), 0])) for key, text in texts)
    by_key, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert 1 <= r.length <= capacity and r.length * 4 == len(r.ids)
        by_key[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for parts in sequences.values():
        end = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end == capacity or end & (end - 1) == 0
    for key, pieces in by_key.items():
        ends = Counter()
        for (k, ids), n in want.items():
            if k == key:
                ends[len(ids)] += n
                for r in (r for r in pieces if r.doc_tokens == len(ids)):
                    part = ids[r.start : r.start + r.length]
                    same_size = sum(1 for (k2, other) in want if k2 == key and len(other) == len(ids))
                    assert same_size > 1 or tuple(np.frombuffer(r.ids, "<u4").tolist()) == part
        for size, n in ends.items():
            assert sum(r.length for r in pieces if r.doc_tokens == size) == size * n
            assert Counter(t for r in pieces if r.doc_tokens == size for t in range(r.start, r.start + r.length)) == Counter(
                {t: n for t in range(size)}
            )
    assert sum(r.length for r in rows) == sum(len(ids) * n for (_, ids), n in want.items())
    return sequences


def test_every_character_is_encoded_as_by_the_library():
    """Rank merges and the library agree on each character next to letters, digits, marks and blanks."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 8192):
        texts = [f"a{c}a1{c}1!{c}! {c}a {c}1 {c}! {c}{c} " for c in points[i : i + 8192]]
        for text, one in zip(texts, WHOLE.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            assert QUICK.ids(text) == one.ids, text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", " <|endo", "don't", " we'll", "\n\n", "  ", "\t", "x" * 50, "12345", "é", "中文", "🙂", ". ", "A"])))
def test_texts_are_encoded_as_by_the_library(parts):
    assert QUICK.ids("".join(parts)) == plain("".join(parts))


def test_texts_beyond_the_quick_length(monkeypatch):
    monkeypatch.setattr(packing, "QUICK_LENGTH", 5)
    assert QUICK.ids("a much longer text") == plain("a much longer text")


@settings(max_examples=400, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 60))
def test_fill_comes_closest(counts, gap):
    best = 0
    for chosen in itertools.product(*[range(c + 1) for c in counts.values()]):
        total = sum(n * c for n, c in zip(counts, chosen))
        best = max(best, total if total <= gap else 0)
    taken = packing.fill(gap, counts)
    assert sum(n * c for n, c in taken.items()) == best
    assert all(0 < c <= counts[n] for n, c in taken.items())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 31), max_size=80))
def test_a_pool_is_packed_without_padding(lengths):
    pool = packing.Pool(32)
    for row, n in enumerate(lengths):
        pool.add(row, 0, np.arange(n))
    sizes, seen = [], defaultdict(list)
    for sequence in pool.emptied():
        sizes.append(sum(len(ids) for _, _, ids in sequence))
        for row, start, ids in sequence:
            assert ids[0] == start
            seen[row] += ids.tolist()
    assert {row: sorted(ids) for row, ids in seen.items()} == {row: list(range(n)) for row, n in enumerate(lengths)}
    assert sizes.count(32) == sum(lengths) // 32
    rest = sorted(s for s in sizes if s < 32)
    assert sum(rest) == sum(lengths) % 32 and all(s & (s - 1) == 0 for s in rest) and len(set(rest)) == len(rest)


def test_windows_repeat_and_cut():
    assert list(packing.windows({600: 2}, 1024)) == [({600: 1}, 1, (600, 424)), ({176: 1}, 1, None)]
    assert list(packing.windows({512: 6, 256: 4}, 1024)) == [({512: 2}, 3, None), ({256: 4}, 1, None)]
    many = list(packing.windows({600: 10**6, 424: 10**6}, 1024))
    assert many == [({600: 1, 424: 1}, 10**6, None)]


ODD = [(1, "one short text"), (1, "one short text"), (2, None), (3, ""), (None, "a b"), (4, "longer text of words " * 900),
       (5, " " * 5000), (6, "<|endoftext|> inside"), (7, "word " * 1023), (8, "wörter 中文 🙂 " * 400)]


def test_frame(docs):
    found = packing.pack(docs(ODD * 3, extra=True), PATH).collect()
    checked(found, ODD * 3)
    small = packing.pack(docs(ODD, extra=True).coalesce(1), PATH, packing.Packing(capacity=64, pool_tokens=200)).collect()
    sequences = checked(small, ODD, 64)
    assert sum(1 for parts in sequences.values() if sum(r.length for r in parts) < 64) <= 6 * 60
    assert packing.pack(docs([]), PATH).collect() == []


def test_invalid_utf8_is_replaced(spark):
    frame = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text")
    assert [r.ids for r in packing.pack(frame, PATH).collect()] == [np.array([*plain("a�b"), 0], "<u4").tobytes()]


def test_refusals(docs):
    with pytest.raises(ValueError):
        packing.pack(docs([]), PATH, packing.Packing(capacity=0))
    with pytest.raises(ValueError):
        packing.pack(docs([]), public_tokenizers.path("word_bpe_49k.json"))


def test_query_on_the_whole_table(spark, sf_dir):
    found = QUERIES["op11_packing"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    ids = {key: np.array([*plain(text), 0], "<u4") for key, text in texts.items()}
    sequences, covered, whole = defaultdict(list), Counter(), 0
    for r in found:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        covered.update((r.doc_id, t) for t in range(r.start, r.start + r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
        whole += r.length == r.doc_tokens
    assert len(covered) == sum(map(len, ids.values())) and set(covered.values()) == {1}
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 1024 or end & (end - 1) == 0
    short = sum(len(i) <= 1024 for i in ids.values())
    assert whole >= 0.75 * short  # most documents here have more than half a sequence
