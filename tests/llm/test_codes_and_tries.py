"""Linear BPE, vector codes and the prefix trie against the library and brute force, on odd rows, hot keys and empty tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plantpulse.llm import linear_bpe, prefix_trie, vector_codes

PATH = P.path("byte_bpe_50k.json")


# -- linear BPE -------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def coder():
    return linear_bpe.LinearBpe(PATH)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


_PIECES = st.sampled_from(["a", "aa", " ", "  ", "\n\n", "\r\n", "\t", "it's", "'LL", "--", "====", "<|endoftext|>", "<|endof", "é", "é", "日本", "½", "12", "\x1c", "\x85", "\xa0",
                           "​", "՘", "₟", "\U00010940", "😀", "the", "ing", " The"])


@settings(max_examples=300, deadline=None)
@given(pieces=st.lists(_PIECES | st.text(max_size=5), max_size=40), size=st.sampled_from([7, 1 << 17]))
def test_linear_bpe_matches_the_library(coder, library, pieces, size):
    text = "".join(pieces).encode("utf-8", "ignore").decode()
    before, linear_bpe.SLICE_CHARS = linear_bpe.SLICE_CHARS, size
    try:
        packed = coder.encode(text)
    finally:
        linear_bpe.SLICE_CHARS = before
    ids = np.frombuffer(packed, "<u4").tolist()
    assert ids == ids_of(library, text)
    assert coder.decode(packed) == library.decode(ids, skip_special_tokens=False) == text


def test_linear_bpe_of_entries_and_sequences_of_entries(coder, library):
    rng = random.Random(2)
    for _ in range(4000):
        text = library.decode([rng.randrange(50_257) for _ in range(rng.randrange(1, 9))], skip_special_tokens=False)
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == ids_of(library, text)


@pytest.mark.parametrize("text", ["a" * 50_000, " " * 50_000 + "x", "ab" * 20_000, "=" * 60_000, "日本語" * 20_000, "-=" * 20_000])
def test_linear_bpe_of_long_runs(coder, library, text):
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == ids_of(library, text)


def test_linear_bpe_with_small_caches(library, monkeypatch):
    monkeypatch.setattr(linear_bpe, "CACHE_ENTRIES", 20)
    monkeypatch.setattr(linear_bpe, "PAIR_ENTRIES", 5)
    own = linear_bpe.LinearBpe(PATH)
    text = "Grüße, it's 12 o'clock\n\n  again and again reconsidered <|endoftext|> unbelievable " * 30
    assert np.frombuffer(own.encode(text), "<u4").tolist() == ids_of(library, text)


def test_linear_bpe_with_special_strings_as_text(library):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    own = linear_bpe.LinearBpe(PATH, special_as_text=True)
    assert np.frombuffer(own.encode("x<|endoftext|>y"), "<u4").tolist() == ids_of(plain, "x<|endoftext|>y") != ids_of(library, "x<|endoftext|>y")


def naive_bpe(word, merges):
    word = list(word)
    while True:
        found = [(merges[pair][0], i) for i, pair in enumerate(zip(word, word[1:])) if pair in merges]
        if not found:
            return word
        i = min(found)[1]
        word[i:i + 2] = [merges[word[i], word[i + 1]][1]]


@settings(max_examples=200, deadline=None)
@given(seed=st.integers(0, 10_000))
def test_compatible_pairs_are_those_that_merging_keeps(seed):
    rng, merges, parts = random.Random(seed), {}, {0: (0,), 1: (1,), 2: (2,)}
    for _ in range(rng.randrange(1, 14)):
        pair = rng.choice(list(parts)), rng.choice(list(parts))
        letters = parts[pair[0]] + parts[pair[1]]
        if pair not in merges and letters not in parts.values():
            merges[pair] = (len(merges), len(parts))
            parts[len(parts)] = letters
    table = linear_bpe.PairTable(len(parts), merges)
    whole = [False] * len(parts)
    for token in parts:
        whole[token] = table.whole(token, whole)
        assert whole[token] == (naive_bpe(parts[token], merges) == [token])
    for a in parts:
        for b in parts:
            if whole[a] and whole[b]:
                assert table.compatible((a, b)) == (naive_bpe(parts[a] + parts[b], merges) == [a, b])


def test_linear_bpe_decodes_bytes_that_are_no_text(coder, library):
    rng = random.Random(4)
    for _ in range(300):
        ids = [rng.randrange(50_257) for _ in range(rng.randrange(8))]
        assert coder.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)
    assert coder.decode(np.array([64, 60_000, 65], "<u4").tobytes()) == library.decode([64, 65])


def test_linear_bpe_documents(odd, odd_rows, none, library):
    both = linear_bpe.decode_documents(linear_bpe.encode_documents(odd, PATH), PATH)
    assert both.columns == [c for c in odd.columns if c != "ids"] + ["ids", "decoded"]
    expected = Counter((r[0], r[10], np.array(ids_of(library, r[1] or ""), "<u4").tobytes(), r[1] or "") for r in odd_rows)
    assert Counter((r["doc_id"], r["_row"], bytes(r["ids"]), r["decoded"]) for r in both.collect()) == expected
    assert linear_bpe.encode_documents(none, PATH, decoded_column="decoded").count() == 0


# -- vector codes -----------------------------------------------------------------------------------------------------

def brute_codes(rows, parts=4, entries=256, rounds=4):
    """vec_id -> (code, error) lists, label errors and digest, by full search in Python's integers."""
    kept = [(i, tuple(math.floor(1024 * x) for x in v), label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    dim = len(kept[0][1]) if kept else 0
    same = [r for r in kept if len(r[1]) == dim]
    size = [dim // parts + (k < dim % parts) for k in range(parts)]
    at = [sum(size[:k]) for k in range(parts + 1)]
    cut = [[v[at[k]:at[k + 1]] for _, v, _ in same] for k in range(parts)]
    books = [c[:entries] for c in cut]

    def assign(book, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for k in range(parts):
            members = defaultdict(list)
            for part in cut[k]:
                members[assign(books[k], part)[1]].append(part)
            books[k] = [tuple(sum(c) // len(members[e]) for c in zip(*members[e])) if e in members else entry for e, entry in enumerate(books[k])]
    found = []
    for j, (i, _, label) in enumerate(same):
        hits = [assign(books[k], cut[k][j]) for k in range(parts)]
        found.append((i, label, "".join(f"{e:02x}" for _, e in hits), min(sum(d for d, _ in hits), 2**63 - 1)))
    found += [(i, label, None, None) for i, v, label in kept if len(v) != dim]
    totals = defaultdict(int)
    for _, label, _, error in found:
        totals[label] += error or 0
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    known = {label for _, label, _, error in found if error is not None}
    return Counter((i, code, error, min(totals[label], 2**63 - 1) if label in known else None, digest) for i, label, code, error in found)


def as_codes(frame):
    return Counter((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in frame.collect())


SCHEMA = "vec_id long, embedding array<double>, label int, code string, error long, no_label int, numbers string, n long"


def odd_vectors(rng, n, dim):
    rows = [(i, [rng.choice([rng.gauss(0, 0.2), rng.gauss(0, 0.2), 0.25, -0.0]) for _ in range(dim)], rng.choice([0, 0, 0, 1, None])) for i in range(n)]
    nan = float("nan")
    rows += [(n, None, 0), (n + 1, [None] * dim, 0), (n + 2, [nan] + [0.0] * (dim - 1), 1), (n + 3, [math.inf] * dim, 1), (None, [0.1] * dim, 1), (3, rows[3][1], rows[3][2])]
    return rows + [(n + 4, [0.5] * (dim + 1), 5), (n + 5, [], None), (n + 6, rows[7][1], 0)]


@pytest.mark.parametrize("n,dim", [(400, 8), (30, 10), (300, 3), (5, 64)])
def test_vector_codes_on_odd_rows(spark, n, dim):
    rows = odd_vectors(random.Random(n), n, dim)
    frame = spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], SCHEMA).repartition(4)
    assert as_codes(vector_codes.coded_vectors(frame)) == brute_codes(rows)


def test_vector_codes_of_huge_numbers_and_copies(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-3, 13) for _ in range(4)], 1) for i in range(300)] + [(1000 + i, [0.3, 0.3, 0.3, 0.3], 2) for i in range(700)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert as_codes(vector_codes.coded_vectors(frame)) == brute_codes(rows)


def test_vector_codes_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_codes.coded_vectors(none).count() == 0
    dropped = spark.createDataFrame([(1, None, 2), (2, [float("nan")], 2)], "vec_id long, embedding array<float>, label int")
    assert vector_codes.coded_vectors(dropped).count() == 0
    empty = spark.createDataFrame([(1, [], 2), (2, [], None)], "vec_id long, embedding array<float>, label int")
    assert {(r["code"], r["error"]) for r in vector_codes.coded_vectors(empty).collect()} == {("00000000", 0)}


@settings(max_examples=60, deadline=None)
@given(seed=st.integers(0, 10_000), scale=st.sampled_from([2, 40, 3000, 1 << 29, 1 << 40, 1 << 61]))
def test_equal_average_search_is_a_full_search(seed, scale):
    rng = np.random.default_rng(seed)
    dim, entries = int(rng.integers(1, 9)), rng.integers(-scale, scale, (int(rng.integers(1, 90)), 1))
    entries = np.concatenate([entries, rng.integers(-scale, scale, (len(entries), dim - 1))], axis=1)
    x = np.concatenate([rng.integers(-scale, scale, (70, dim)), entries[rng.integers(0, len(entries), 20)]])
    index, best = vector_codes.EqualAverageSearch(entries).nearest(x)
    full = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(row, entry)), e) for e, entry in enumerate(entries)) for row in x]
    assert [(int(d), int(e)) for d, e in zip(best, index)] == full


@pytest.mark.parametrize("seed", [4072, 4114, 4291])
def test_search_goes_on_where_only_the_distance_fits_64_bits(seed):
    """A best distance times the number of components passed 64 bits, so the search ended before the nearest entry."""
    test_equal_average_search_is_a_full_search.hypothesis.inner_test(seed, 1 << 29)


def test_equal_average_search_skips_entries(monkeypatch):
    rng = np.random.default_rng(1)
    entries = np.repeat(rng.integers(-2000, 2000, (256, 1)), 8, axis=1) + rng.integers(-3, 4, (256, 8))
    seen = []
    whole = vector_codes.squared_distances
    monkeypatch.setattr(vector_codes, "squared_distances", lambda x, e: seen.append(len(x) * len(e)) or whole(x, e))
    vector_codes.EqualAverageSearch(entries).nearest(entries.repeat(8, axis=0))
    assert sum(seen) < 256 * 8 * 256 / 2


def test_vector_codes_decode_to_entries(spark):
    rows = odd_vectors(random.Random(3), 300, 8)
    kept = vector_codes.kept_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    books = vector_codes.fitted_codebooks(kept)
    codes = vector_codes.with_codes(kept, books)
    found = {r["vec_id"]: r for r in vector_codes.decoded(codes, books).collect()}
    for i, v, _ in rows[:300]:
        whole = [math.floor(1024 * x) for x in v]
        assert sum((a - round(b * 1024)) ** 2 for a, b in zip(whole, found[i]["decoded"])) == found[i]["error"]
    assert found[304]["decoded"] is None


# -- prefix trie ------------------------------------------------------------------------------------------------------

def turn_key(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def original(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, turn_key(role or "", text or ""), role or "", text or ""))
    return {c: [t[3:] for t in sorted(turns)] for c, turns in convs.items()}


def rebuilt(convs, family=5, spread=9):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % spread
        out[c] = convs.get(c - int(math.fmod(c, family)), [])[:h] + turns[h:]
    return out


def brute_trie(convs):
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(convs):
        turns = tuple(convs[c])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                kids[turns[:d - 1]].add(turns[:d])
        ends[turns].append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        leaves[node] = sum(leaves[k] for k in kids[node]) if kids[node] else 1
        saved[node] = own + sum(saved[k] for k in kids[node])
    return Counter((m[0], len(n), members[n[:-1]][0] if n else None, len(m), len(kids[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest())
                   for n, m in members.items())


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id long, turn long, role string, text string, depth int, p1 string, part int, ends_sha256 int, band long"


def as_nodes(frame):
    return Counter(tuple(r) for r in frame.select(*NAMES).collect())


def odd_turns(rng, convs, most):
    rows = []
    for c in convs:
        for k in range(rng.randrange(1, most)):
            rows.append((c, k, rng.choice(["user", "assistant", None, ""]) if rng.random() < 0.1 else "user", rng.choice(["a", "b", "é" * 3, None, ""])))
    rows += [(None, 0, "user", "a"), (None, None, None, None), (7, None, "x", "first"), (7, None, "y", "also first"), (8, 0, "user", "tie"), (8, 0, "user", "tie"), (8, 0, "b", "tie")]
    rows += [(-4, 0, "user", "a"), (-10, 0, "user", "b"), (10**15, 3, "user", "a")]
    return rows + [(100 + k, j, "user", "same") for k in range(60) for j in range(3)]


@pytest.mark.parametrize("height", [2, 3, 16])
def test_rebuilt_trie_on_odd_rows(spark, height):
    rows = odd_turns(random.Random(height), range(0, 60), 14)
    frame = spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], TURNS).repartition(3)
    assert as_nodes(prefix_trie.rebuilt_prefix_trie(frame, height=height)) == brute_trie(rebuilt(original(rows)))
    assert as_nodes(prefix_trie.prefix_trie(frame, height=height)) == brute_trie(original(rows))


def test_trie_of_a_conversation_over_many_parts(spark):
    rows = [(5, k, "user", f"t{k % 7}") for k in range(400)] + [(c, k, "user", f"t{k % 7}") for c in (6, 7, 11) for k in range(5 * c)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
        turns = prefix_trie.numbered_turns(frame)
        assert sorted((r["conv_id"], r["at"]) for r in turns.collect()) == sorted((c, k) for c, k, _, _ in rows)
        assert as_nodes(prefix_trie.trie(prefix_trie.rebuilt_paths(turns), height=4)) == brute_trie(rebuilt(original(rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_with_many_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_AT_ONCE", 7)
    rows = [(c, k, "user", "same") for c in range(500) for k in range(2)] + [(1000 + c, 0, "user", f"own {c}") for c in range(40)]
    frame = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    assert as_nodes(prefix_trie.prefix_trie(frame)) == brute_trie(original(rows))


def test_trie_of_nothing_and_texts_of_nodes(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.rebuilt_prefix_trie(none).count() == 0 and prefix_trie.prefix_trie(none).count() == 0
    rows = [(1, 0, "user", "long " * 20_000), (1, 1, "assistant", "x"), (2, 0, "user", "long " * 20_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = prefix_trie.with_last_turn(prefix_trie.prefix_trie(frame), frame)
    assert {(r["depth"], r["role"], r["text"], r["n_convs"]) for r in found.collect()} == {(0, None, None, 2), (1, "user", "long " * 20_000, 2), (2, "assistant", "x", 1)}
