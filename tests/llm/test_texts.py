"""Exact dedup, n-gram join, byte BPE, token files and packing against brute force, on odd rows and on an empty table."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plantpulse.llm import bpe, exact_dedup, huffman, ngram_join, packing, tokens
from plantpulse.session import shared_folder, stored


def bag(rows):
    return Counter(tuple(r) for r in rows)


# -- exact dedup ------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("digests", [True, False])
def test_exact_groups(odd, odd_rows, digests):
    groups = defaultdict(list)
    for r in odd_rows:
        text = r[1] or ""
        groups[re.sub(r"[\x20\x09-\x0D]", "", text)].append((r[0], len(text)))
    expected = Counter()
    for norm, rows in groups.items():
        known = [x for x in rows if x[0] is not None]
        best = max((n, 1 if i is not None else 0, -(i or 0)) for i, n in rows) if not known else None
        longest = max(rows, key=lambda x: (x[1], x[0] is not None, -(x[0] or 0)))
        assert best is None or longest[0] is None
        for i, _ in rows:
            expected[(i, longest[0], len(rows), i == longest[0], hashlib.sha256(norm.encode()).hexdigest())] += 1
    found = exact_dedup.exact_groups(odd, digests=digests)
    names = ["doc_id", "keep_id", "group_size", "kept"] + ["text_sha256"] * digests
    assert bag(found.select(*names).collect()) == Counter({k[:len(names)]: n for k, n in _merged(expected, len(names)).items()})


def _merged(counter, n):
    out = Counter()
    for k, v in counter.items():
        out[k[:n]] += v
    return out


def test_exact_groups_with_a_hot_group(spark):
    rows = [(i, "same text") for i in range(3000)] + [(i, f"text {i}") for i in range(3000, 4000)]
    found = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.filter("kept").count() == 1001
    assert found.filter("group_size = 3000 AND keep_id = 0").count() == 3000


# -- n-gram join ------------------------------------------------------------------------------------------------------

def brute_components(rows):
    sets = {}
    for i, text in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = frozenset(tuple(found[k:k + 5]) for k in range(max(1, len(found) - 4))) if found else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_on_odd_rows(odd, odd_rows):
    found = ngram_join.near_duplicates(odd)
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()]
    assert len(rows) == len(odd_rows)
    assert {r for r in rows if r[0] is not None} == brute_components([(r[0], r[1]) for r in odd_rows if r[0] is not None])
    assert sorted(r[2] is None for r in rows if r[0] is None) == [True, True]


def test_near_duplicates_in_chains_and_families(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(4000)]
    rows = []
    for _ in range(12):  # families with members further apart than a link, and a passage that all documents share
        text = rng.choices(vocabulary, k=rng.randrange(30, 150))
        for _ in range(rng.randrange(1, 14)):
            text = list(text)
            for _ in range(rng.randrange(3)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(text)))
    passage = " ".join(vocabulary[:40])
    rows += [(1000 + k, passage + " " + " ".join(rng.choices(vocabulary, k=rng.randrange(3, 60)))) for k in range(40)]
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()} == brute_components(rows)


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates_count_all_links(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "_COLUMNS", 64)
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for _ in range(8):  # families of three and more different near copies, each with exact copies
        text = rng.choices(vocabulary, k=rng.randrange(40, 120))
        for _ in range(rng.randrange(3, 12)):
            text = list(text)
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows += [(len(rows) + k, " ".join(text)) for k in range(rng.choice([1, 1, 3]))]
    rows += [(len(rows), None), (len(rows) + 1, "alone here"), (None, rows[0][1])]
    known = [(i, set(ngram_join.shingle_set(t).tolist())) for i, t in rows if i is not None]
    expected = {i: sum(bool(x) and j != i and 100 * len(x & y) >= 80 * len(x | y) for j, y in known) for i, x in known} | {None: 0}
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["n_links"] for r in found.collect()} == expected and max(expected.values()) > 5


@pytest.mark.parametrize("block", [512, 2])
def test_near_duplicates_in_one_wide_family(spark, monkeypatch, block):
    """A family in which many pairs fall short of a link, sizes that cross bands, and groups of several sets behind one prefix."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    text = rng.choices(vocabulary, k=100)
    rows = []
    for i in range(120):
        own = list(text[:rng.randrange(70, 101)])
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        rows.append((i, " ".join(own)))
    rare, common = [rng.choices(vocabulary, k=k) for k in (40, 8)]
    for i in range(30):  # often repeated ends vary behind rare words that stay the same
        rows += [(200 + i, " ".join(rare + common[i % 8:] + common[:i % 8]))] + [(300 + 10 * i + k, " ".join(common[i % 8:] + common[:i % 8] + rng.choices(vocabulary, k=40))) for k in range(8)]
    known = [(i, set(ngram_join.shingle_set(t).tolist())) for i, t in rows]
    expected = {i: sum(j != i and 100 * len(x & y) >= 80 * len(x | y) for j, y in known) for i, x in known}
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found} == brute_components(rows)
    assert {r["doc_id"]: r["n_links"] for r in found} == expected and min(expected.values()) == 0


# -- byte-level BPE ---------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def coder():
    return bpe.ByteBpe(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=80))
def test_byte_bpe_matches_the_rank_rule(coder, reference, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = coder.encode(text)
    assert list(np.frombuffer(ids, "<u4")) == reference.encode_ordinary(text)
    assert coder.decode(ids) == text.encode()


def test_byte_bpe_reaches_each_entry_and_long_texts(coder, reference, monkeypatch):
    monkeypatch.setattr(bpe, "PRETOKENS_AT_ONCE", 7)
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 20)
    text = "Grüße, it's 12 o'clock\n\n  again " * 40
    assert list(np.frombuffer(coder.encode(text), "<u4")) == reference.encode_ordinary(text)
    assert coder.decode(coder.encode(text)) == text.encode()


def test_byte_bpe_documents(odd, odd_rows, none, reference):
    vocabulary = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    both = bpe.decode_documents(bpe.encode_documents(odd, *vocabulary), *vocabulary)
    assert both.columns == [c for c in odd.columns if c != "ids"] + ["ids", "decoded"]
    expected = Counter((r[0], b"".join(struct.pack("<I", i) for i in reference.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in odd_rows)
    assert Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in both.collect()) == expected
    assert bpe.encode_documents(none, *vocabulary).count() == 0


# -- token ids of chunks ----------------------------------------------------------------------------------------------

@pytest.fixture(scope="module", params=[("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def both_tokenizers(request):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path(request.param[0]))
    whole.encode_special_tokens = True
    return whole, tokens.ChunkedTokenizer(P.path(request.param[0]), request.param[1])


_PIECES = st.sampled_from([" ", "  ", "\n", " \n", "\t", "\x1c", "\x85", "\xa0", "a", "Ab", "it's", ".", "!!", "é", "é", "́", "12", "½", "<|endoftext|>", "日本",
                           "İ", "Σς", "ß", "​", "\r\n", "　", "word.", "word,", "(x)", "क़!", "word%%%"])


@settings(max_examples=200, deadline=None)
@given(pieces=st.lists(_PIECES | st.text(max_size=4), max_size=40), size=st.sampled_from([5, 1 << 20]))
def test_chunks_have_the_ids_of_whole_texts(both_tokenizers, pieces, size):
    whole, chunked = both_tokenizers
    text = "".join(pieces).encode("utf-8", "ignore").decode()
    before, tokens.SLICE_CHARS = tokens.SLICE_CHARS, size
    try:
        assert list(chunked.encode(text)) == whole.encode(text, add_special_tokens=False).ids
    finally:
        tokens.SLICE_CHARS = before


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.lists(_PIECES | st.text(max_size=4), max_size=20), max_size=8), size=st.sampled_from([1, 30, 1 << 22]), entries=st.sampled_from([3, 600_000]),
       kind=st.sampled_from([pa.string(), pa.large_string()]))
def test_columns_have_the_ids_of_whole_texts(both_tokenizers, texts, size, entries, kind):
    whole, chunked = both_tokenizers
    texts = ["".join(pieces).encode("utf-8", "ignore").decode() for pieces in texts]
    before = tokens.COLUMN_BYTES, tokens.CACHE_ENTRIES
    tokens.COLUMN_BYTES, tokens.CACHE_ENTRIES = size, entries
    try:
        found = [list(part) for ids, sizes in chunked.encode_column(pa.array(["x", *texts], kind).slice(1)) for part in np.split(ids, np.cumsum(sizes))[:-1]]
    finally:
        tokens.COLUMN_BYTES, tokens.CACHE_ENTRIES = before
    assert found == [whole.encode(text, add_special_tokens=False).ids for text in texts]


def test_a_word_is_encoded_once_in_any_case_and_with_any_punctuation(monkeypatch):
    chunked, seen = tokens.ChunkedTokenizer(P.path("word_bpe_49k.json"), True), []
    for name in ("encoded", "packed"):
        if (plain := getattr(tokens.WordModel, name, None)):
            monkeypatch.setattr(tokens.WordModel, name, lambda self, words, plain=plain: (seen.extend(words), plain(self, words))[1])
    for text in ("Straße straße STRAßE, (straße) straße!!", "straße. Straße"):
        chunked.encode(text)
    assert seen == ["straße"]


# -- token files ------------------------------------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(counts=st.lists(st.integers(0, 5000), min_size=1, max_size=40), bits=st.integers(6, 16))
def test_codes_are_prefix_free_and_best(counts, bits):
    counts = np.array(counts)
    lengths = huffman.code_lengths(counts, bits)
    used = lengths[lengths > 0]
    assert (lengths > 0).tolist() == (counts > 0).tolist()
    if len(used) > 1:
        assert used.max() <= bits and abs(sum(2.0**-used) - 1) < 1e-9
    if bits == 16 and len(used) > 1:  # no limit reached: the cost is Huffman's
        import heapq

        heap, cost = [int(c) for c in counts if c], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        if used.max() < 16:
            assert int((counts * lengths).sum()) == cost


def test_blocks_round_trip():
    rng = np.random.default_rng(4)
    blocks = [rng.geometric(0.02, n).astype("<u4") for n in (1, 255, 256, 257, 5000)]
    counts = np.bincount(np.concatenate(blocks))
    lengths = huffman.code_lengths(counts, 12)
    codes = huffman.canonical_codes(lengths)
    coded = [huffman.encode_block(b, codes, lengths) for b in blocks]
    found = huffman.Decoder(lengths).decode([p for _, p in coded], [c for c, _ in coded], [len(b) for b in blocks])
    assert all((a == b).all() for a, b in zip(found, blocks))


@pytest.mark.parametrize("block_ids", [64, 1 << 16])
def test_token_files_round_trip(spark, odd, odd_rows, block_ids):
    from tokenizers import Tokenizer

    path, folder = P.path("word_bpe_49k.json"), shared_folder(spark)
    huffman.write_tokens(odd, folder, path, end_id=2, drops_white_space=True, block_ids=block_ids)
    found = [(r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in huffman.read_tokens(spark, folder).collect()]
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    expected, start = [], 0
    for doc_id, text in sorted(((r[0], r[1] or "") for r in odd_rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = whole.encode(text, add_special_tokens=False).ids + [2]
        expected.append((doc_id, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sorted(found, key=lambda x: x[1]) == expected


def test_only_documents_longer_than_a_block_are_split(spark):
    folder = shared_folder(spark)
    docs = spark.createDataFrame([(i, " ".join(["word"] * (150 if i == 7 else 10 + i))) for i in range(30)], "doc_id long, text string")
    huffman.write_tokens(docs, folder, P.path("word_bpe_49k.json"), end_id=2, drops_white_space=True, block_ids=64)
    blocks = spark.read.parquet(f"{folder}/blocks").filter("continued or open").orderBy("part", "block").collect()
    assert [(r["doc_ids"], r["n_ids"] <= 64) for r in blocks[:2]] == [([7], True)] * 2
    assert len(blocks) == 3 and blocks[2]["doc_ids"][0] == 7 and not blocks[2]["open"]
    assert sorted((r["doc_id"], r["n_tokens"]) for r in huffman.read_tokens(spark, folder).collect()) == [(i, 151 if i == 7 else 11 + i) for i in range(30)]


# -- packing ----------------------------------------------------------------------------------------------------------

def fewest(sizes, capacity):
    best = [len(sizes)]

    def place(rest, rooms):
        if len(rooms) >= best[0]:
            return
        if not rest:
            best[0] = len(rooms)
            return
        for k in {room: k for k, room in enumerate(rooms) if room >= rest[0]}.values():
            place(rest[1:], rooms[:k] + [rooms[k] - rest[0]] + rooms[k + 1:])
        place(rest[1:], rooms + [capacity - rest[0]])

    place(sorted(sizes, reverse=True), [])
    return best[0]


@settings(max_examples=300, deadline=None)
@given(data=st.data(), capacity=st.sampled_from([10, 20, 50]))
def test_reduction_keeps_the_best_packing(data, capacity):
    sizes = data.draw(st.lists(st.integers(1, capacity), max_size=9))
    counts = Counter(sizes)
    fixed, left = packing.reduce_by_dominance(dict(counts), capacity)
    used = Counter()
    for pattern, times in packing.plan(dict(counts), capacity):
        assert sum(s * k for s, k in pattern.items()) <= capacity
        for s, k in pattern.items():
            used[s] += k * times
    assert used == counts
    assert sum(times for _, times in fixed) + fewest([s for s, n in left.items() for _ in range(n)], capacity) == fewest(sizes, capacity)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packed_documents(spark, odd, odd_rows, capacity):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    expected = Counter()
    for r in odd_rows:
        ids = np.array(whole.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
        first = len(ids) % capacity or capacity
        for k, a in enumerate([0, *range(first, len(ids), capacity)]):
            b = first if k == 0 else a + capacity
            expected[(r[0], k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    placed = stored(packing.pack(stored(packing.token_pieces(odd, path, 0, capacity=capacity, with_ids=True)), capacity))
    rows = placed.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    assert {r["sequence_id"]: len(bytes(r["ids"])) // 4 for r in packing.sequences(placed).collect()} == {
        s: sum(n for _, n in pieces) for s, pieces in by_sequence.items()}


# -- empty tables -----------------------------------------------------------------------------------------------------

def test_empty_tables(spark, none):
    assert exact_dedup.exact_groups(none).count() == 0
    assert ngram_join.near_duplicates(none).count() == 0
    assert packing.packed_documents(none, P.path("byte_bpe_50k.json"), 0).count() == 0
    folder = shared_folder(spark)
    huffman.write_tokens(none, folder, P.path("word_bpe_49k.json"), end_id=2, drops_white_space=True)
    assert huffman.read_tokens(spark, folder).count() == 0
