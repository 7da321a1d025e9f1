"""Exact byte-level BPE in linear time, by backtracking over the longest matches, for a ``tokenizers`` file.

A list of tokens is the BPE result of its bytes exactly when each token is the result of its own bytes and each neighbouring pair is
compatible: no merge across the seam comes before the merges that made the two tokens. The encoder takes the longest token that
matches at a place (one Aho-Corasick pass gives these for all places), falls back to the next shorter prefix while the pair with the
token before is incompatible, and steps back where no prefix is left; a place given up once is never tried again, which bounds the
work. Verdicts on pairs are kept in a table. The decoder cuts tokens from one string of all tokens' bytes by a table of offsets.

Texts are cut as the file's byte-level pre-tokenizer cuts them. Strings of added tokens become their ids, as in the plain call of the
library, unless ``special_as_text``. Truncation and padding of the file are not applied.

Defined results: a null text counts as empty; an empty text has no ids and decodes to an empty text. Texts are encoded whole, whatever
their length, in bounded slices. Ids that the file does not know decode to nothing, null ids to null; bytes that are no UTF-8 decode to
the replacement character. Repeated rows give repeated results. Other columns of the input are passed through untouched, but for one
with the name of a result. A file with another kind of model, normaliser or pre-tokenizer raises ValueError.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .bpe import byte_characters
from .common import with_computed

#: pre-tokens kept with their ids in each Python worker
CACHE_ENTRIES = 400_000
#: verdicts on pairs kept in each Python worker
PAIR_ENTRIES = 1 << 20
#: characters of a text that are cut into pre-tokens at a time
SLICE_CHARS = 1 << 17
#: ids that are decoded at a time
IDS_AT_ONCE = 1 << 18

#: fixed value: how a byte-level pre-tokenizer cuts
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: characters whose class may differ between Unicode versions; slices with one take the library's own pre-tokenizer
_NEWER = re.compile("[^\x00-՗ -⁯]")
#: the pre-tokenizer certainly cuts before this space
_CUT = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


class PairTable:
    """Which tokens can stand side by side in a BPE result.

    ``merges`` maps a pair of ids to its rank and its product. Of a token made by a merge, the table knows both parts and the rank.
    """

    def __init__(self, n_tokens: int, merges: dict[tuple[int, int], tuple[int, int]]):
        self.rank = {pair: rank for pair, (rank, _) in merges.items()}
        self.made = [-1] * n_tokens
        self.left, self.right = list(range(n_tokens)), list(range(n_tokens))
        for (a, b), (rank, token) in merges.items():
            if self.made[token] >= 0:
                raise ValueError(f"token {token} is the product of two merges")
            self.made[token], self.left[token], self.right[token] = rank, a, b
        self.known: dict[tuple[int, int], bool] = {}

    def compatible(self, pair: tuple[int, int]) -> bool:
        found = self.known.get(pair)
        if found is None:
            if len(self.known) >= PAIR_ENTRIES:
                self.known.clear()
            found = self.known[pair] = self.holds(pair)
        return found

    def holds(self, pair: tuple[int, int], before: int = 1 << 62) -> bool:
        """No merge across the seam of a rank below ``before`` precedes the merges that made the two tokens.

        The tokens at the seam are taken back in time, the later merge first. Of merges of equal rank the left one is the earlier.
        """
        made, rank = self.made, self.rank
        a, b = pair
        while True:
            across = rank.get((a, b))
            if across is not None and across < before:
                return False
            if made[a] > made[b]:
                before, a = min(before, made[a]), self.right[a]
            elif made[b] >= 0:
                before, b = min(before, made[b] + 1), self.left[b]
            else:
                return True

    def whole(self, token: int, is_whole: list[bool]) -> bool:
        """Whether BPE makes this token of its own bytes, given the same for its parts."""
        a, b = self.left[token], self.right[token]
        return self.made[token] < 0 or is_whole[a] and is_whole[b] and self.holds((a, b), before=self.made[token])


class LinearBpe:
    """Encoder and decoder over one file."""

    def __init__(self, path: str, special_as_text: bool = False):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as lines:
            spec = json.load(lines)
        model = spec["model"]
        _check(spec)
        vocabulary: dict[str, int] = model["vocab"]
        added = {entry["content"]: entry["id"] for entry in spec["added_tokens"]}
        n_tokens = max([*vocabulary.values(), *added.values(), 0]) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.pairs = PairTable(n_tokens, {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)})
        is_whole = [False] * n_tokens
        for token in sorted(vocabulary.values(), key=self.pairs.made.__getitem__):
            is_whole[token] = self.pairs.whole(token, is_whole)
        characters = byte_characters()
        single = set(characters)
        self.token_of = {text: token for text, token in vocabulary.items() if is_whole[token] and (self.pairs.made[token] >= 0 or text in single)}
        if not single <= self.token_of.keys():
            raise ValueError("the vocabulary lacks bytes")
        self.length = [0] * n_tokens
        self.shorter = [-1] * n_tokens
        self.automaton = ahocorasick.Automaton()
        for text, token in self.token_of.items():
            self.length[token] = len(text)
            self.shorter[token] = next((self.token_of[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in self.token_of), -1)
            self.automaton.add_word(text, token)
        self.automaton.make_automaton()
        self.characters = dict(enumerate(characters))
        self.pattern = regex.compile(PRETOKEN)
        self.pretokenizer = None
        self.path = path
        self.special = {} if special_as_text else {text: np.uint32(token).tobytes() for text, token in added.items() if text}
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._lay_out(vocabulary | added, n_tokens)
        self.cache: dict[str, bytes] = {}

    def _lay_out(self, tokens: dict[str, int], n_tokens: int) -> None:
        byte_of = {character: b for b, character in enumerate(byte_characters())}
        parts = [b""] * n_tokens
        for text, token in tokens.items():
            parts[token] = bytes(map(byte_of.__getitem__, text)) if all(c in byte_of for c in text) else text.encode()
        self.blob = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def tokens(self, word: str) -> list[int]:
        """Ids of one pre-token, given as its mapped bytes."""
        whole = self.token_of.get(word)
        if whole is not None:
            return [whole]
        length, shorter, compatible = self.length, self.shorter, self.pairs.compatible
        n = len(word)
        longest = [0] * n
        for end, token in self.automaton.iter(word):  # ends ascend, so the last match from a place is its longest
            longest[end - length[token] + 1] = token
        open_ends = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            before = out[-1] if out else -1
            while token >= 0 and not (open_ends[at + length[token]] and (before < 0 or compatible((before, token)))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:
                open_ends[at] = 0
                token = out.pop()
                at -= length[token]
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(self._packed(text or ""))

    def _packed(self, text: str) -> Iterator[bytes]:
        start = 0
        for found in self.special_pattern.finditer(text) if self.special_pattern else ():
            yield from self._plain(text, start, found.start())
            yield self.special[found.group()]
            start = found.end()
        yield from self._plain(text, start, len(text))

    def _plain(self, text: str, start: int, end: int) -> Iterator[bytes]:
        while end - start > SLICE_CHARS and (cut := _CUT.search(text, start + SLICE_CHARS, end)):
            yield self._slice(text[start:cut.start()])
            start = cut.start()
        yield self._slice(text[start:end])

    def _slice(self, text: str) -> bytes:
        words = self._own_words(text) if _NEWER.search(text) else self.pattern.findall(text)
        known = self.cache
        if new := {w for w in words if w not in known}:
            if len(known) + len(new) > CACHE_ENTRIES:
                known = self.cache = {w: known[w] for w in set(words) - new}
            mapped = "\n".join(new) if not any("\n" in w for w in new) else None
            forms = (mapped.encode().decode("latin-1").translate(self.characters | {10: "\n"}).split("\n") if mapped is not None
                     else [w.encode().decode("latin-1").translate(self.characters) for w in new])
            for word, form in zip(new, forms, strict=True):
                known[word] = np.array(self.tokens(form), dtype="<u4").tobytes()
        return b"".join(map(known.__getitem__, words))

    def _own_words(self, text: str) -> list[str]:
        if self.pretokenizer is None:
            from tokenizers import Tokenizer

            self.pretokenizer = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.pretokenizer.pre_tokenize_str(text)]

    def decode_bytes(self, ids: bytes) -> bytes:
        numbers = np.frombuffer(ids, dtype="<u4")
        return b"".join(self._cut_out(numbers[i:i + IDS_AT_ONCE]) for i in range(0, len(numbers), IDS_AT_ONCE))

    def _cut_out(self, numbers: np.ndarray) -> bytes:
        numbers = numbers[numbers < len(self.offsets) - 1].astype(np.int64)
        first, size = self.offsets[numbers], self.offsets[numbers + 1] - self.offsets[numbers]
        into = np.cumsum(size) - size
        return self.blob[np.repeat(first - into, size) + np.arange(int(size.sum()))].tobytes()

    def decode(self, ids: bytes) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _check(spec: dict) -> None:
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    odd = [name for name in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(name)]
    if odd or model["type"] != "BPE" or spec["normalizer"] or (before.get("type"), before.get("add_prefix_space"), before.get("use_regex")) != ("ByteLevel", False, True):
        raise ValueError("only byte-level BPE without normaliser is supported")
    if any(entry[name] for entry in spec["added_tokens"] for name in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take white space or need word borders are not supported")


@lru_cache(maxsize=2)
def linear_bpe(path: str, special_as_text: bool = False) -> LinearBpe:
    """One per Python worker and file."""
    return LinearBpe(path, special_as_text)


def encode_documents(docs: DataFrame, path: str, text_column: str = "text", ids_column: str = "ids", decoded_column: str | None = None,
                     keep: list[str] | None = None, special_as_text: bool = False) -> DataFrame:
    """``docs`` with a binary column of ids, packed as little-endian unsigned 32-bit integers.

    With ``decoded_column`` the packed ids are decoded again in the same pass. ``keep`` names the columns to return besides.
    """
    def make():
        coder = linear_bpe(path, special_as_text)

        def compute(part):
            ids = [coder.encode(text.as_py()) for text in part.column(text_column)]
            return {ids_column: ids} | ({decoded_column: [coder.decode(packed) for packed in ids]} if decoded_column else {})

        return compute

    added = f"`{ids_column}` binary" + (f", `{decoded_column}` string" if decoded_column else "")
    return with_computed(docs, added, make, rows=64, keep=keep)


def decode_documents(docs: DataFrame, path: str, ids_column: str = "ids", decoded_column: str = "decoded") -> DataFrame:
    """``docs`` with the text that the packed ids stand for."""
    def make():
        coder = linear_bpe(path)
        return lambda part: {decoded_column: [None if ids is None else coder.decode(ids) for ids in part.column(ids_column).to_pylist()]}

    return with_computed(docs, f"`{decoded_column}` string", make, rows=64)
