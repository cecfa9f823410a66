"""Documents packed into training sequences by minimum bin slack.

Every document is tokenised whole and closed by a separator. Runs of a full
capacity leave it as sequences of their own; the rest, shorter than a sequence,
joins a pool. From a pool, one window after another is filled: the longest piece
is set, and a subset-sum over the lengths that remain, held as the bits of one
integer, finds the multiset that fills the gap closest to capacity. A length that
occurs several times enters in bundles of 1, 2, 4, ... copies; walking back
through the bundles gives the count of each length. The same window is repeated
as often as the counts allow, so that the programming runs once per different
window and not once per sequence.

Where no multiset reaches the capacity, every piece left is longer than the gap,
and one of them is cut to close it. What is left in the end is less than one
sequence; it is cut into sequences whose lengths are powers of two, which need no
padding. So no sequence is padded, and few documents shorter than a sequence are cut.

Pools are filled and emptied inside a task, and bounded by tokens: nothing is
shuffled, no count of the corpus is needed, and a lost executor repeats its tasks
only. Sequences are numbered within a partition, below the partition's number.
"""

from __future__ import annotations

import json
import os
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysieve.llm.bpe import check_tokenizer
from keysieve.llm.common import valid_text, worker_memory

CAPACITY = 1024
SEPARATOR = 0
POOL_TOKENS = 1 << 22
BATCH_ROWS = 512
NUMBER_BITS = 33
QUICK_LENGTH = 1 << 20

# Fixed value: the pre-tokenizer's pattern of the byte-level tokenizers that the library calls ByteLevel.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Packing:
    """Tokens of a sequence, the id that closes a document, and the tokens a pool holds at most."""

    capacity: int = CAPACITY
    separator: int = SEPARATOR
    pool_tokens: int = POOL_TOKENS


def byte_names() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable characters of Latin-1 stand for themselves, the others for the
    characters from 256 on, in ascending order.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


def by_ranks(settings: dict):
    """An encoder that merges by rank, if that is the same for this tokenizer; otherwise None.

    It is when merges are listed in the order of the ids they make, each of two
    tokens of the vocabulary, and at most one special token is cut out of texts.
    """
    model, added = settings["model"], settings.get("added_tokens", [])
    vocab, bytes_of = model["vocab"], byte_names()
    merges = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
    made = [vocab.get("".join(pair)) for pair in merges]
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "ignore_merges", "byte_fallback"))
    if not plain or made != list(range(256, 256 + len(merges))) or len(added) > 1:
        return None
    special = {one["content"]: one["id"] for one in added}
    ranks = {bytes(bytes_of[c] for c in name): i for name, i in vocab.items() if name not in special}
    if sorted(ranks.values()) != list(range(256 + len(merges))):
        return None
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


class Encoder:
    """Ids of whole texts, as the tokenizers library gives them.

    Texts are encoded by rank where that is known to be the same; the tests
    compare both on every character. Other tokenizers, and texts of more than a
    million characters, go to the library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            self.ranks = by_ranks(json.load(file))

    def ids(self, text: str) -> list[int]:
        if self.ranks is None or len(text) > QUICK_LENGTH:
            return self.library.encode(text, add_special_tokens=False).ids
        return self.ranks.encode(text, allowed_special="all")


def worker_encoder(path: str) -> Encoder:
    known = worker_memory()
    if ("packing", path) not in known:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker for every core
        known["packing", path] = Encoder(path)
    return known["packing", path]


def fill(gap: int, counts: dict[int, int]) -> dict[int, int]:
    """How many of each length to take so that their sum comes closest to the gap from below.

    Bit s of ``reach`` tells whether some multiset adds up to s. Long pieces come
    first, and the search ends as soon as the gap itself is reached.
    """
    reach, mask, steps = 1, (2 << gap) - 1, []
    for length in sorted((n for n in counts if n <= gap), reverse=True):
        left, bundle = min(counts[length], gap // length), 1
        while left and not reach >> gap & 1:
            bundle = min(bundle, left)
            steps.append((length, bundle, reach))
            reach |= reach << length * bundle & mask
            left -= bundle
            bundle *= 2
    total, taken = reach.bit_length() - 1, defaultdict(int)
    for length, bundle, before in reversed(steps):
        if not before >> total & 1:
            total -= length * bundle
            taken[length] += bundle
    return dict(taken)


def windows(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int, tuple[int, int] | None]]:
    """Windows that use up all pieces: lengths with their counts, how often, and a cut ``(length, head)``.

    A cut takes the first ``head`` tokens of one more piece; the rest is a piece
    again. The last window may be short and needs no cut.
    """
    counts = {n: c for n, c in counts.items() if c}
    while counts:
        longest = max(counts)
        rest = counts | {longest: counts[longest] - 1}
        taken = fill(capacity - longest, {n: c for n, c in rest.items() if c})
        taken[longest] = taken.get(longest, 0) + 1
        slack = capacity - sum(n * c for n, c in taken.items())
        times = 1 if slack else min(counts[n] // c for n, c in taken.items())
        for n, c in taken.items():
            counts[n] -= c * times
        counts = {n: c for n, c in counts.items() if c}
        cut = None
        if slack and counts:
            longest = max(counts)  # longer than the gap, or it would have been taken
            cut = (longest, slack)
            for n, c in ((longest, -1), (longest - slack, 1)):
                counts[n] = counts.get(n, 0) + c
            counts = {n: c for n, c in counts.items() if c}
        yield taken, times, cut


class Pool:
    """Pieces shorter than a sequence; each is ``(row, start, ids)``."""

    def __init__(self, capacity: int):
        self.capacity, self.pieces, self.tokens = capacity, defaultdict(list), 0

    def add(self, row, start: int, ids: np.ndarray) -> None:
        self.pieces[len(ids)].append((row, start, ids))
        self.tokens += len(ids)

    def emptied(self) -> Iterator[list]:
        """The sequences of all pieces, each a list of pieces in order."""
        pieces = self.pieces
        for taken, times, cut in windows({n: len(p) for n, p in pieces.items()}, self.capacity):
            for _ in range(times):
                sequence = [pieces[n].pop() for n, c in taken.items() for _ in range(c)]
                if cut:
                    row, start, ids = pieces[cut[0]].pop()
                    sequence.append((row, start, ids[: cut[1]]))
                    pieces[cut[0] - cut[1]].append((row, start + cut[1], ids[cut[1] :]))
                yield from self.unpadded(sequence)
        self.pieces, self.tokens = defaultdict(list), 0

    def unpadded(self, sequence: list) -> Iterator[list]:
        """The sequence itself if full, otherwise sequences of powers of two, the longest first."""
        left = sum(len(ids) for _, _, ids in sequence)
        if left == self.capacity:
            yield sequence
            return
        queue = sequence[::-1]
        while left:
            room = 1 << left.bit_length() - 1
            left -= room
            part = []
            while room:
                row, start, ids = queue.pop()
                part.append((row, start, ids[:room]))
                if len(ids) > room:
                    queue.append((row, start + room, ids[room:]))
                room -= len(part[-1][2])
            yield part


def pack(
    frame: DataFrame, tokenizer_path: str, packing: Packing = Packing(), text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``(key, start, length, doc_tokens, sequence_id, offset, ids)``, one row per piece of a document.

    ``ids`` holds little-endian 32-bit integers. Pieces of one row tile its tokens,
    the separator included; pieces of one sequence tile it from 0. Sequences have
    ``capacity`` tokens, or a power of two. A null or empty text is its separator
    alone. Rows with a null key and repeated rows are packed like any other, each
    with its separator. Texts of any length are encoded whole; invalid UTF-8 is
    replaced by U+FFFD. Other columns are not looked at. An empty frame gives no
    rows. Which documents share a sequence depends on how the rows are partitioned.
    """
    if packing.capacity < 1 or packing.pool_tokens < 1:
        raise ValueError("a sequence and a pool hold at least one token")
    check_tokenizer(tokenizer_path)
    source = frame.select(F.col(key).alias("key"), valid_text(text).alias("text"))
    capacity, name = packing.capacity, key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer_path)
        number = TaskContext.get().partitionId() << NUMBER_BITS
        pool = Pool(capacity)

        def placed(sequences: Iterator[list]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            keys, numbers, ids = [], [], []
            for sequence in sequences:
                offset = 0
                for (row_key, n_tokens), start, part in sequence:
                    keys.append(row_key)
                    numbers.append((start, len(part), n_tokens, number, offset))
                    ids.append(part.tobytes())
                    offset += len(part)
                number += 1
                if len(keys) >= 1 << 14:
                    yield batch_of(keys, numbers, ids)
                    keys, numbers, ids = [], [], []
            if keys:
                yield batch_of(keys, numbers, ids)

        def batch_of(keys, numbers, ids) -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in np.array(numbers, dtype=np.int64).T]
            arrays = [pa.array(keys, key_type), *columns, pa.array(ids, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, [name, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        key_type = None
        for whole in batches:
            key_type = whole.column(0).type
            for first in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(first, BATCH_ROWS)
                full = []
                for row_key, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids = encoder.ids(one or "")
                    ids.append(packing.separator)
                    ids = np.array(ids, dtype="<u4")
                    row, end = (row_key, len(ids)), len(ids) // capacity * capacity
                    full += [[(row, start, ids[start : start + capacity])] for start in range(0, end, capacity)]
                    if end < len(ids):
                        pool.add(row, end, ids[end:])
                    if pool.tokens >= packing.pool_tokens:
                        yield from placed(pool.emptied())
                yield from placed(full)
        if pool.tokens:
            yield from placed(pool.emptied())

    fields = [T.StructField(name, source.schema["key"].dataType)]
    fields += [T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens", "sequence_id", "offset")]
    return source.mapInArrow(run, T.StructType([*fields, T.StructField("ids", T.BinaryType())]))


def digests(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The pieces with a checksum of their ids instead of the ids."""
    return packed.select(key, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
