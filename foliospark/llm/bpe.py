"""Byte-level BPE through a sentencepiece model serialised from ranks (operator 1).

The model is written field by field from the vocabulary alone: each token's
bytes are mapped to one code point each, its score is its negative rank, and
the normaliser is the identity, so sentencepiece merges in rank order exactly as
a rank encoder does. Pre-tokens are encoded one by one; decoding maps ids back
to pieces and pieces back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import PATTERN

#: Bytes become this block of code points: no white space, no control characters.
FIRST_CODE_POINT = 0x4E00
#: Bytes of pre-tokens, each with about so much besides its text, that a worker remembers
#: before it starts afresh; longer pre-tokens than so many characters it never does.
REMEMBERED_BYTES, ENTRY_BYTES, LONGEST = 128 << 20, 300, 64
#: Characters of texts that are split and learnt together.
TOGETHER = 1_000_000


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value & (1 << 64) - 1)


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model whose ids are the ranks; the id after the last is unknown.

    Field numbers are those of the public model description: pieces 1 (piece 1,
    score 2, type 3), trainer 2 (model type 3, vocabulary size 4, special ids
    40-43), normaliser 3 (name 1, three white-space switches 3-5).
    """
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    normal, unknown, bpe = 1, 2, 2
    pieces = [
        _message(1, _message(1, token.decode("latin-1").translate(_TO_POINTS).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -rank) + _number(3, normal))
        for rank, token in enumerate(tokens)
    ]
    pieces.append(_message(1, _message(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, unknown)))
    trainer = _number(3, bpe) + _number(4, len(pieces)) + _number(40, len(tokens)) + _number(41, -1) + _number(42, -1) + _number(43, -1)
    normaliser = _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _message(2, trainer) + _message(3, normaliser)


_TO_POINTS = {b: chr(FIRST_CODE_POINT + b) for b in range(256)}
_TO_BYTES = {FIRST_CODE_POINT + b: chr(b) for b in range(256)}


class ByteBpe:
    """Encodes and decodes; remembers what pre-tokens became."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.split = regex.compile(pattern).findall
        self.vocabulary = [p.translate(_TO_BYTES).encode("latin-1") for p in map(self.model.id_to_piece, range(len(ranks)))]
        self.shown: dict[str, str] = {}
        self.bytes: dict[str, bytes] = {}
        self.held = 0

    def _encoded(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        return zip(words, self.model.encode([w.encode().decode("latin-1").translate(_TO_POINTS) for w in words], num_threads=1))

    def _learn(self, words: set[str]) -> dict[str, list[int]]:
        """Remember the words that are not long; returns the ids of those that are."""
        if self.held > REMEMBERED_BYTES:
            self.shown.clear()
            self.bytes.clear()
            self.held = 0
        new = words.difference(self.shown)
        short = [w for w in new if len(w) <= LONGEST]
        vocabulary, shown, raw = self.vocabulary, self.shown, self.bytes
        for w, ids in self._encoded(short):
            shown[w] = ",".join(map(str, ids))
            raw[w] = b"".join([vocabulary[i] for i in ids])
        self.held += ENTRY_BYTES * len(short) + 20 * sum(map(len, short))
        return dict(self._encoded([w for w in new if len(w) > LONGEST]))

    def encode(self, text: str) -> list[int]:
        shown = self.round_trip(text)[0]
        return list(map(int, shown.split(","))) if shown else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))

    def round_trip(self, text: str) -> tuple[str, bytes]:
        """The decimal ids joined by commas, and the bytes that they decode to."""
        return next(self.round_trips([text]))

    def round_trips(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """The same for each text. Texts up to ``TOGETHER`` characters are learnt together:
        nearly every text has some new word, and one call for many costs less."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= TOGETHER):
                size += len(texts[end])
                end += 1
            split = [self.split(t) for t in texts[at:end]]
            extra = self._learn(set().union(*split))
            shown, raw = self.shown, self.bytes
            if extra:
                shown = shown | {w: ",".join(map(str, ids)) for w, ids in extra.items()}
                raw = raw | {w: self.decode(ids) for w, ids in extra.items()}
            for words in split:
                yield ",".join(map(shown.__getitem__, words)), b"".join(map(raw.__getitem__, words))
            at = end


@lru_cache(maxsize=2)
def coder(path: str, pattern: str = PATTERN) -> ByteBpe:
    return ByteBpe(load_ranks(path), pattern)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    A map over whole texts, without a shuffle. A null text is empty (no ids, both
    digests of the empty string); null and repeated ids are carried along; other
    columns are ignored.
    """
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path, pattern)
        for batch in batches:
            counts, ids_digests, decoded_digests = [], [], []
            for shown, decoded in bpe.round_trips(common.texts(batch[1])):
                counts.append(shown.count(",") + 1 if shown else 0)
                ids_digests.append(hashlib.sha256(shown.encode()).hexdigest())
                decoded_digests.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(decoded_digests, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
