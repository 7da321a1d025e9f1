"""Byte-level BPE by a sentencepiece model that is written from a rank vocabulary.

Each byte is mapped to one printable character, each vocabulary entry becomes a piece of such characters scored by its negative rank,
and the normaliser is the identity. Sentencepiece then merges the pair of best score first, leftmost on ties, which is the merge rule
of the rank vocabulary. Pre-tokens are encoded on their own; decoding is the inverse mapping of pieces to bytes.

Defined results: a null text counts as empty; an empty text has no ids and decodes to no bytes. Texts are encoded whole, whatever their
length, piece by piece in bounded lists. Repeated rows give repeated results. Other columns of the input are passed through untouched.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame

from .common import with_computed

#: pre-tokens kept with their ids in each Python worker
CACHE_ENTRIES = 400_000
#: pre-tokens of one text that are held at a time
PRETOKENS_AT_ONCE = 200_000


def byte_characters() -> list[str]:
    """A printable, non-white character for each byte: itself where Latin-1 has one, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def _field(number: int, content: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(content)) + content


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model: piece 0 is unknown, piece i is the i-th entry by rank."""
    characters = byte_characters()
    pieces = [(b"<unk>", 0.0, 2)]
    for token, rank in sorted(ranks.items(), key=lambda entry: entry[1]):
        pieces.append(("".join(characters[b] for b in token).encode(), -float(rank), 1))
    body = b"".join(_field(1, _field(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))
                    for piece, score, kind in pieces)
    trainer = _number(3, 2) + _number(4, len(pieces))  # model type BPE, vocabulary size
    trainer += _number(40, 0) + b"".join(_varint(n << 3) + b"\xff" * 9 + b"\x01" for n in (41, 42, 43))  # unknown 0; no begin, end, pad
    normalizer = _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)  # no prefix, no white space rules
    return body + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encoder and decoder over one vocabulary file."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(ranks_path)
        self.pattern = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        by_rank = sorted(ranks.values())
        self.rank_of_piece = np.array([0, *by_rank], dtype="<u4")
        byte_of = {character: b for b, character in enumerate(byte_characters())}
        self.bytes_of_id = {rank: bytes(byte_of[c] for c in self.model.id_to_piece(i + 1)) for i, rank in enumerate(by_rank)}
        self.characters = {b: c for b, c in enumerate(byte_characters())}
        self.whole = {token.decode(): struct.pack("<I", rank) for token, rank in ranks.items() if _is_text(token)}
        self.cache: dict[str, bytes] = {}

    def _learn(self, pretokens: set[str]) -> dict[str, bytes]:
        """Ids of pre-tokens, packed. A pre-token that is an entry of the vocabulary is that entry; the model merges all others."""
        found = {p: self.whole[p] for p in pretokens if p in self.whole}
        rest = [p for p in pretokens if p not in found]
        mapped = [p.encode().decode("latin-1").translate(self.characters) for p in rest]
        for pretoken, pieces in zip(rest, self.model.encode(mapped, out_type=int, num_threads=1)):
            found[pretoken] = self.rank_of_piece[pieces].tobytes()
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(text) <= PRETOKENS_AT_ONCE:
            return self._packed(self.pattern.findall(text))
        matches, out = self.pattern.finditer(text), []
        while part := [match.group() for match in islice(matches, PRETOKENS_AT_ONCE)]:
            out.append(self._packed(part))
        return b"".join(out)

    def _packed(self, pretokens: list[str]) -> bytes:
        known = self.cache
        if new := {p for p in pretokens if p not in known}:
            learned = self._learn(new)
            if len(known) + len(learned) > CACHE_ENTRIES:
                known = {p: known[p] for p in pretokens if p in known} | learned
            else:
                known.update(learned)
        return b"".join(map(known.__getitem__, pretokens))

    def decode(self, ids: bytes) -> bytes:
        numbers = np.frombuffer(ids, dtype="<u4")
        return b"".join(b"".join(map(self.bytes_of_id.__getitem__, numbers[i:i + PRETOKENS_AT_ONCE].tolist()))
                        for i in range(0, len(numbers), PRETOKENS_AT_ONCE))


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


@lru_cache(maxsize=2)
def byte_bpe(ranks_path: str, pattern: str) -> ByteBpe:
    """One per Python worker and vocabulary."""
    return ByteBpe(ranks_path, pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text_column: str = "text", ids_column: str = "ids",
                     bytes_column: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a binary column of ids, packed as little-endian unsigned 32-bit integers.

    With ``bytes_column`` the packed ids are decoded again in the same pass. ``keep`` names the columns to return besides.
    """
    def make():
        coder = byte_bpe(ranks_path, pattern)

        def compute(part):
            ids = [coder.encode(text or "") for text in part.column(text_column).to_pylist()]
            return {ids_column: ids} | ({bytes_column: [coder.decode(packed) for packed in ids]} if bytes_column else {})

        return compute

    added = f"`{ids_column}` binary" + (f", `{bytes_column}` binary" if bytes_column else "")
    return with_computed(docs, added, make, keep=keep)


def decode_documents(docs: DataFrame, ranks_path: str, pattern: str, ids_column: str = "ids", bytes_column: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that the packed ids stand for: the UTF-8 of the text they came from. Null ids decode to null."""
    def make():
        coder = byte_bpe(ranks_path, pattern)
        return lambda part: {bytes_column: [None if ids is None else coder.decode(ids) for ids in part.column(ids_column).to_pylist()]}

    return with_computed(docs, f"`{bytes_column}` binary", make)
