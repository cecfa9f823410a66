"""Byte-level BPE encoding and decoding that reuses chunks across documents.

A rolling hash over the last few bytes cuts every text at places that depend on
content alone, so a passage that two documents share is cut alike in both. A
chunk is encoded once and remembered by its bytes; each later occurrence, in
whichever document the worker meets it, costs a dictionary lookup.

A cut may fall inside a word, where encoding the two sides apart would give
other tokens than encoding the whole. So each join is repaired: the stretch
around the cut is encoded again, and grows on both sides until it agrees with
encoding the whole text. It agrees as soon as it ends where a printable ASCII
character is followed by a space or a newline: no alternative of the byte-level
pre-tokenizer's pattern holds white space after another character, none looks
back, and a look-ahead before such a place never reaches past it, so tokens to
the left and to the right do not depend on each other. A special token holds no
white space either. A chunk without such a place joins the stretch whole.

Memory of a worker is bounded: chunks are remembered in two generations, and the
older one is dropped when the younger is full. Nothing is shuffled. A lost
executor loses remembered chunks only; they are encoded again.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysieve.llm.common import per_batch, worker_memory

WINDOW = 8
AVERAGE_CHUNK = 4
REMEMBERED = 120_000
LONGEST_REMEMBERED = 512
BATCH_ROWS = 512
BLOCK = 1 << 22
CHAIN_BYTES = 2048


@dataclass(frozen=True)
class Chunking:
    """Bytes that the rolling hash sees, and the mean distance of cuts (a power of two)."""

    window: int = WINDOW
    average: int = AVERAGE_CHUNK


def gear_table() -> np.ndarray:
    """A fixed odd number for each byte, mixed by multiplication and shifts."""
    mixed = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(24)) | np.uint64(1)).astype(np.uint32)


GEAR = gear_table()


def cuts(raw: np.ndarray, chunking: Chunking = Chunking()) -> np.ndarray:
    """Offsets at which the text is cut: where the hash of the bytes before is a multiple.

    The hash of ``window`` bytes is summed up by doubling: that of two halves,
    the older one shifted. Blocks overlap by the window, so their borders do not show.
    """
    places = []
    for start in range(0, len(raw), BLOCK):
        from_ = max(0, start - chunking.window)
        piece = raw[from_ : start + BLOCK]
        rolled, width = GEAR[piece], 1
        while width < chunking.window:
            older = np.zeros_like(rolled)
            older[width:] = rolled[:-width]
            rolled = rolled + older * np.uint32((2 * 0x9E3779B1) ** width % (1 << 32) | 1)
            width *= 2
        top = (rolled >> np.uint32(16)) & np.uint32(chunking.average - 1)
        found = np.flatnonzero(top == 0) + from_ + 1
        places.append(found[(found > start) & (found < len(raw))])
    return np.concatenate(places) if places else np.zeros(0, dtype=np.int64)


def joints(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ascending borders of the pieces to encode: chunk bodies and repaired joins in turn.

    For each cut, the nearest safe places on both sides; the ends of the text are safe.
    """
    blank = (raw[1:] == 32) | (raw[1:] == 10)
    safe = np.flatnonzero(blank & (raw[:-1] > 32) & (raw[:-1] < 127)) + 1
    safe = np.concatenate(([0], safe, [len(raw)]))
    left = safe[np.searchsorted(safe, at, side="right") - 1]
    right = safe[np.searchsorted(safe, at, side="left")]
    border = np.zeros(len(raw) + 1, dtype=bool)
    border[left] = border[right] = border[0] = border[-1] = True
    return np.flatnonzero(border)


class ChunkEncoder:
    """Encodes and decodes texts with one tokenizer file; remembers chunks."""

    def __init__(self, path: str, chunking: Chunking = Chunking(), remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunking, self.remembered = chunking, remembered
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.lengths = np.array([len(name) for name in names])  # one character stands for one byte
        #: Ids of remembered chunks, of this generation and the last. All decode to themselves but those listed apart.
        self.ids: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.long: list[bytes] = []
        self.decoded_otherwise: dict[bytes, str] = {}

    def encode_apart(self, pieces: list[bytes]) -> None:
        """Encodes and decodes pieces that are not remembered, and remembers them.

        Pieces that begin with a blank and end with a printable ASCII character may
        stand one after another, for the reason given above; some are encoded as one
        text and the tokens dealt back by their lengths. Others are encoded alone.
        """
        groups, chain, size = [], [], 0
        for piece in pieces:
            if piece[0] in (10, 32) and 32 < piece[-1] < 127:
                chain.append(piece)
                size += len(piece)
                if size >= CHAIN_BYTES:
                    groups.append(chain)
                    chain, size = [], 0
            else:
                groups.append([piece])
        groups += [chain] if chain else []
        texts = [b"".join(group).decode() for group in groups]
        tokens_of = [one.ids for one in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        decoded_of = self.tokenizer.decode_batch(tokens_of, skip_special_tokens=False)
        for group, ids, text, decoded in zip(groups, tokens_of, texts, decoded_of, strict=True):
            packed = np.array(ids, dtype="<u4")
            if len(group) == 1:
                self.ids[group[0]] = packed.tobytes()
                if decoded != text:
                    self.decoded_otherwise[group[0]] = decoded
                continue
            if decoded != text:
                raise ValueError("a chain of chunks does not decode to itself")
            ends = np.cumsum([len(piece) for piece in group])
            at = 4 * np.searchsorted(np.cumsum(self.lengths[packed]), ends, side="right")
            packed, start = packed.tobytes(), 0
            for piece, end in zip(group, at.tolist()):
                self.ids[piece] = packed[start:end]
                start = end

    def turn(self) -> None:
        """After a batch: long pieces are forgotten, and the older generation once the younger is full."""
        for piece in self.long:
            self.ids.pop(piece, None)
        self.long.clear()
        if len(self.ids) >= self.remembered:
            self.older, self.ids = self.ids, {}

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """One pair of ids and decoded text for each text; a null text is empty."""
        split = []
        for text in texts:
            whole = (text or "").encode()
            raw = np.frombuffer(whole, dtype=np.uint8)
            if len(raw):
                borders = joints(raw, cuts(raw, self.chunking)).tolist()
                split.append([whole[a:b] for a, b in zip(borders, borders[1:])])
            else:
                split.append([])
        new = []
        for piece in set().union(*split).difference(self.ids):
            known = self.older.get(piece)
            if known is None:
                new.append(piece)
                if len(piece) > LONGEST_REMEMBERED:
                    self.long.append(piece)
            else:
                self.ids[piece] = known
        self.encode_apart(new)
        known, result = self.ids, []
        for text, pieces in zip(texts, split, strict=True):
            decoded = text or ""  # the pieces in order, each of which decodes to itself
            if self.decoded_otherwise:
                decoded = "".join([self.decoded_otherwise.get(p) or p.decode() for p in pieces])
            result.append((b"".join(map(known.__getitem__, pieces)), decoded))
        self.turn()
        return result


def worker_encoder(path: str, chunking: Chunking, remembered: int) -> ChunkEncoder:
    """The encoder of this Python worker: it outlives a task, and so do its chunks."""
    known = worker_memory()
    key = ("bpe", path, chunking.window, chunking.average, remembered)
    if key not in known:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker for every core
        known[key] = ChunkEncoder(path, chunking, remembered)
    return known[key]


def check_tokenizer(path: str) -> None:
    """Refuses a file for which the proof above does not hold."""
    with open(path, encoding="utf-8") as file:
        settings = json.load(file)
    before, after = settings.get("pre_tokenizer") or {}, settings.get("decoder") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    specials = [t for t in settings.get("added_tokens", []) if any(c.isspace() for c in t["content"]) or t.get("lstrip")
                or t.get("rstrip") or t.get("single_word")]
    if not plain or after.get("type") != "ByteLevel" or settings.get("normalizer") or specials:
        raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")


def encode(
    frame: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", chunking: Chunking = Chunking(),
    remembered: int = REMEMBERED,
) -> DataFrame:
    """``(key, n_tokens, ids, decoded)``: ids as packed little-endian 32-bit integers.

    One row per row, repeated rows and null keys included. A null or empty text
    has no tokens and decodes to the empty text. Texts of any length are encoded
    whole. Other columns of the frame are not looked at. An empty frame gives none.
    """
    check_tokenizer(tokenizer_path)
    source = frame.select(F.col(key).alias("key"), F.col(text).alias("text"))
    name = key

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = worker_encoder(tokenizer_path, chunking, remembered)
        done = encoder.encode(batch.column(1).to_pylist())
        counts = pa.array([len(ids) // 4 for ids, _ in done], pa.int64())
        ids = pa.array([ids for ids, _ in done], pa.binary())
        decoded = pa.array([text for _, text in done], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), counts, ids, decoded], [name, "n_tokens", "ids", "decoded"])

    schema = T.StructType(
        [
            T.StructField(name, source.schema["key"].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("decoded", T.StringType()),
        ]
    )
    return source.mapInArrow(per_batch(work, BATCH_ROWS), schema)


def unpacked(ids: bytes) -> list[int]:
    return np.frombuffer(ids, dtype="<u4").tolist()


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hashes of ids and of decoded texts, for comparing without the contents."""
    return encoded.select(
        key,
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
