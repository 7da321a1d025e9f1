"""Token ids of whole texts by a ``tokenizers`` file, with the ids of frequent chunks kept in each Python worker.

A text is cut where the pre-tokenizer of the file certainly cuts as well, so that the ids of a text are those of its chunks in a row:
at a single space or line feed between two characters that are not white space (the space leads the next chunk), or, for a vocabulary
that drops white space, at every space and line feed. A chunk of letters with punctuation behind it is looked up in two parts. New words of
Latin-1 letters, which no normaliser or pre-tokenizer takes apart, go straight to the library's BPE model, many in one call; the model's
own marks (word end, or the mapped leading space) tell their ids apart. Everything else, of any length, takes the library's whole way.

Many texts are cut at once as an Arrow column: a chunk is looked at once per slice of texts, however often it stands there, and the ids are
put in place by arrays. Where white space is kept, texts with white space other than single spaces and line feeds are cut one by one.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bpe import byte_characters

#: chunks kept with their ids in each Python worker
CACHE_ENTRIES = 600_000
#: characters of a text that are cut into chunks at a time
SLICE_CHARS = 1 << 20
#: bytes of texts that are cut into columns of chunks at a time
COLUMN_BYTES = 1 << 22
#: chunks that the library encodes in one call
CALL_CHUNKS = 4096

_CUT = re.compile(r"(?<=\S) (?=\S)")
_OTHER_WHITE = re.compile(r"[^\S \n]")
#: Latin-1 letters, which stay letters in any normaliser, and ASCII punctuation without the apostrophe of contractions
_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_WORD_AND_TAIL = re.compile(rf"({_WORD.pattern})([!-&(-/:-@\[-^_`{{-~]+)")
#: texts of a vocabulary that keeps white space which are not cut as a column, for Arrow's expressions
_ODD = r"\A[ \n]|[ \n][ \n]|[ \n]\z|[\x00" + "".join(f"\\x{{{i:x}}}" for i in range(0x3001) if _OTHER_WHITE.match(chr(i))) + "]"
_LETTERS = "".join(c for c in map(chr, range(0x41, 0x100)) if _WORD.fullmatch(c))
_TAIL = "".join(c for c in map(chr, range(0x21, 0x7F)) if _WORD_AND_TAIL.fullmatch(f"a{c}"))


class WordModel:
    """Ids of plain words from the BPE model alone: ``lead`` is put before each word.

    Where tokens show that they end or begin a word, these marks tell words apart, else the library's numbers of words.
    """

    def __init__(self, tokenizer, lead: str, lower: bool):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.model = Tokenizer(tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        self.characters = dict(enumerate(byte_characters()))
        self.lead, self.lower = lead.encode().decode("latin-1").translate(self.characters), lower
        vocabulary = tokenizer.get_vocab()
        marked = (lambda t: t.startswith(self.lead)) if lead else (lambda t: t.endswith("</w>"))
        self.border = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.border[[i for t, i in vocabulary.items() if marked(t)]] = True
        self.is_marked = bool(self.border.any())

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and where each word begins, with the end of the last."""
        text = "\n".join(words)
        mapped = (text.lower() if self.lower else text).encode().decode("latin-1").translate(self.characters | {10: f"\n{self.lead}"})
        encode = self.model.encode_batch_fast if self.is_marked else self.model.encode_batch
        found = encode([self.lead + mapped], add_special_tokens=False)[0]
        ids = np.array(found.ids, dtype="<u4")
        if not self.is_marked:
            return ids, np.searchsorted(np.array(found.word_ids), np.arange(len(words) + 1))
        at = np.flatnonzero(self.border[ids])
        return ids, np.append(at, len(ids)) if self.lead else np.append(0, at + 1)

    def packed(self, words: list[str]) -> list[bytes]:
        ids, edges = self.encoded(words)
        data, edges = ids.tobytes(), (4 * edges).tolist()
        return [data[a:b] for a, b in zip(edges, edges[1:])]


class Chunks:
    """The packed ids of chunks of one kind, those with a space before them or those without."""

    def __init__(self, tokenizer, lead: str, words: WordModel | None, tails: Chunks | None):
        self.tokenizer, self.lead, self.words, self.tails = tokenizer, lead, words, tails or self
        self.known: dict[str, bytes] = {"": b""}

    def packed(self, chunks: list[str]) -> bytes:
        return b"".join(map(self.ready(chunks).__getitem__, chunks))

    def ready(self, chunks: list[str]) -> dict[str, bytes]:
        """A table that holds the packed ids of the given chunks."""
        known = self.known
        if new := {c for c in chunks if c not in known}:
            if len(known) + len(new) > CACHE_ENTRIES:
                known = {c: known[c] for c in set(chunks) - new}
            self._learn(list(new), known)
        return known

    def _learn(self, new: list[str], known: dict[str, bytes]) -> None:
        halves = {c: m.groups() for c in new if (m := _WORD_AND_TAIL.fullmatch(c))}
        whole = {c for c in new if c not in halves} | {head for head, _ in halves.values() if head not in known}
        words = [c for c in whole if _WORD.fullmatch(c)] if self.words else []
        for start in range(0, len(words), CALL_CHUNKS):
            part = words[start:start + CALL_CHUNKS]
            known.update(zip(part, self.words.packed(part), strict=True))
        rest = list(whole.difference(words))
        for start in range(0, len(rest), CALL_CHUNKS):
            part = rest[start:start + CALL_CHUNKS]
            found = self.tokenizer.encode_batch_fast([self.lead + c for c in part], add_special_tokens=False)
            known.update((c, np.array(e.ids, dtype="<u4").tobytes()) for c, e in zip(part, found))
        for c, (head, tail) in halves.items():
            known[c] = known[head] + (self.tails.known.get(tail) or self.tails.packed([tail]))


def _gathered(ids: np.ndarray, start: np.ndarray, size: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of ``ids`` that are picked by their numbers, in a row, and their sizes."""
    sizes = size[picked]
    at = np.repeat(start[picked] - np.cumsum(sizes) + sizes, sizes)
    at += np.arange(len(at))
    return ids[at], sizes


class ChunkColumns:
    """The ids of columns of chunks. Words are known without their punctuation and in the case of the vocabulary.

    Where the vocabulary keeps white space, a chunk holds the space that leads it.
    """

    def __init__(self, tokenizer, drops_white_space: bool):
        self.tokenizer, self.lower = tokenizer, drops_white_space
        self.words = {lead: WordModel(tokenizer, lead, self.lower) for lead in ([""] if drops_white_space else ["", " "])}
        self.forget()

    def forget(self) -> None:
        self.slots = {"": 0}  # the number of a known chunk; its ids are ids[start:start + size]
        self.ids, self.start, self.size = np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def encoded(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks in a row, and the number of ids of each."""
        met = chunks.dictionary_encode()
        heads = pc.ascii_rtrim(met.dictionary, characters=_TAIL)
        plain = pc.match_substring_regex(heads, rf"\A ?{_WORD.pattern}\z")
        is_plain = plain.to_numpy(zero_copy_only=False)
        words = heads.filter(plain)
        words = (pc.utf8_lower(words) if self.lower else words).dictionary_encode()
        tails = pc.utf8_ltrim(met.dictionary.filter(plain), characters=f" {_LETTERS}").dictionary_encode()
        # words hold no line feed: one long string is taken apart faster than a column
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary), "\n")[0].as_py()
        slots = self._slots(joined.split("\n") if joined else [], tails.dictionary.to_pylist(), met.dictionary.filter(pc.invert(plain)).to_pylist())
        parts = np.zeros((len(is_plain), 2), dtype=np.int64)  # a chunk is a word and its tail, or a whole and nothing
        parts[is_plain, 0] = slots[0][words.indices.to_numpy()]
        parts[is_plain, 1] = slots[1][tails.indices.to_numpy()]
        parts[~is_plain, 0] = slots[2]
        ids, sizes = _gathered(self.ids, self.start, self.size, parts.reshape(-1))
        sizes = sizes.reshape(-1, 2).sum(axis=1)
        return _gathered(ids, np.cumsum(sizes) - sizes, sizes, met.indices.to_numpy())

    def _slots(self, words: list[str], *others: list[str]) -> list[np.ndarray]:
        """The numbers of all given chunks; ``words`` are plain ones and come once."""
        new = [w for w in words if w not in self.slots]
        rest = list(dict.fromkeys(c for part in others for c in part if c not in self.slots))
        if new or rest:
            if len(self.slots) + len(new) + len(rest) > CACHE_ENTRIES:
                self.forget()
                new, rest = words, list(dict.fromkeys(c for part in others for c in part if c))
            self._learn(new, rest)
        return [np.fromiter(map(self.slots.__getitem__, part), dtype=np.int64, count=len(part)) for part in (words, *others)]

    def _learn(self, new: list[str], rest: list[str]) -> None:
        found, kinds = ([], []), {lead: [w for w in new if w.startswith(" ") == bool(lead)] for lead in self.words}
        for lead, words in kinds.items():
            for start in range(0, len(words), CALL_CHUNKS):
                ids, edges = self.words[lead].encoded([w[len(lead):] for w in words[start:start + CALL_CHUNKS]])
                found[0].append(ids)
                found[1].append(np.diff(edges))
        for start in range(0, len(rest), CALL_CHUNKS):
            for e in self.tokenizer.encode_batch_fast(rest[start:start + CALL_CHUNKS], add_special_tokens=False):
                found[0].append(np.array(e.ids, dtype="<u4"))
                found[1].append([len(e.ids)])
        sizes = np.concatenate(found[1]).astype(np.int64)
        self.slots.update(zip([*chain(*kinds.values(), rest)], range(len(self.slots), len(self.slots) + len(sizes)), strict=True))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.ids = np.concatenate([self.ids, *found[0]])


class ChunkedTokenizer:
    """``drops_white_space``: the vocabulary keeps no white space, so every space and line feed is a place to cut."""

    def __init__(self, path: str, drops_white_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.drops_white_space = drops_white_space
        self.columns = ChunkColumns(tokenizer, drops_white_space)
        if not drops_white_space:
            self.bare = Chunks(tokenizer, "", self.columns.words[""], None)
            self.led = Chunks(tokenizer, " ", self.columns.words[" "], self.bare)
            self.line_feed = self.bare.packed(["\n"])

    def forget(self) -> None:
        """Give the memory of known chunks back, at the end of a task: the worker may go on with something else."""
        self.columns.forget()
        for chunks in () if self.drops_white_space else (self.bare, self.led):
            chunks.known = {"": b""}

    def encode(self, text: str | None) -> np.ndarray:
        text, out, start = text or "", [], 0
        while len(text) - start > SLICE_CHARS and (cut := _CUT.search(text, start + SLICE_CHARS)):
            out.append(self._slice(text[start:cut.start()], start > 0))
            start = cut.end()
        out.append(self._slice(text[start:], start > 0))
        return np.concatenate(out)

    def encode_column(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For one slice of the texts (strings without nulls) after the other: the ids of its texts in a row, and the number of ids of each."""
        start = size = 0
        for i, n in enumerate(pc.binary_length(texts).to_pylist()):
            if size and size + n > COLUMN_BYTES:
                yield self._encoded(texts.slice(start, i - start), size)
                start, size = i, 0
            size += n
        if start < len(texts):
            yield self._encoded(texts.slice(start), size)

    def documents(self, texts: pa.Array, end_id: int) -> Iterator[np.ndarray]:
        """The ids of each text, followed by ``end_id``."""
        for ids, sizes in self.encode_column(texts):
            ends = np.cumsum(sizes)
            ids = np.insert(ids, ends, np.uint32(end_id))
            ends = (ends + np.arange(1, len(ends) + 1)).tolist()
            for start, end in zip([0, *ends], ends):
                yield ids[start:end]

    def _encoded(self, texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
        odd = np.full(len(texts), size > COLUMN_BYTES)
        if not self.drops_white_space and size <= COLUMN_BYTES:
            odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._column(texts.cast(pa.string()))
        ids, sizes = self._column(texts.filter(pa.array(~odd)).cast(pa.string()))
        cut = iter(np.split(ids, np.cumsum(sizes)))
        found = [self.encode(text.as_py()) if is_odd else next(cut) for text, is_odd in zip(texts, odd)]
        return np.concatenate(found), np.array([*map(len, found)])

    def _column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.drops_white_space:
            chunks = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        else:
            chunks = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, "\n", "\0\n\0"), " ", "\0 "), "\0")
        ids, sizes = self.columns.encoded(chunks.flatten())
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(pc.list_value_length(chunks).to_numpy()))]
        return ids, np.diff(ends)

    def _slice(self, text: str, led: bool) -> np.ndarray:
        """``led``: a space stood before the slice."""
        if self.drops_white_space:
            return self.columns.encoded(pa.array(text.replace("\n", " ").split(" "), pa.string()))[0]
        return np.frombuffer(self._packed_slice(text, led), dtype="<u4")

    def _packed_slice(self, text: str, led: bool) -> bytes:
        lines = [line.split(" ") for line in text.split("\n")]
        if any("" in line for line in lines) or _OTHER_WHITE.search(text):
            parts = _CUT.split(text)
            return self.led.packed(parts) if led else self.bare.packed(parts[:1]) + self.led.packed(parts[1:])
        first = self.bare.ready([line[0] for line in lines])
        later = self.led.ready([chunk for line in lines for chunk in line[1:]])
        out = []
        for line in lines:
            out.append(first[line[0]])
            out.extend(map(later.__getitem__, line[1:]))
            out.append(self.line_feed)
        if led:
            out[0] = self.led.packed(lines[0][:1])
        return b"".join(out[:-1])


@lru_cache(maxsize=2)
def chunked_tokenizer(path: str, drops_white_space: bool) -> ChunkedTokenizer:
    """One per Python worker and file."""
    return ChunkedTokenizer(path, drops_white_space)
