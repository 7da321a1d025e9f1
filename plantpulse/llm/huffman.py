"""Token files: ids in canonical, length-limited Huffman codes, in independent blocks with bit-offset checkpoints.

A token folder holds ``blocks`` and ``codebook``, both Parquet, so that any store Spark knows will do and a failed task leaves nothing
behind. A block is coded on its own: its payload, the bit offset of every 256th id, and the documents that begin or go on in it. Blocks
of one part follow each other, parts follow the range of the document id, so ids stand in ascending order of doc_id (null first,
equal ids by text). The codebook is made of the counts of all ids.

Decoding looks codes up in a table of all bit patterns of the longest code, from all checkpoints of several blocks at once.

Defined results: a null text counts as empty; an empty text still has the end id. Repeated rows are written as often as they occur. An
empty table gives an empty folder that reads back as no rows. A block ends with a document; only texts longer than a block are split over
several.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder
from .common import send_few_rows
from .tokens import chunked_tokenizer

BLOCK_IDS = 1 << 16
CHECKPOINT_IDS = 256
#: the longest code; the decoding table has 2 to this power entries
MAX_BITS = 16
#: blocks decoded at once
DECODE_BLOCKS = 16

_BLOCK = "part int, block int, first_id long, n_ids int, doc_ids array<long>, doc_at array<int>, first_doc long, continued boolean, open boolean"
_RAW = f"{_BLOCK}, counts binary, ids binary"
_CODED = f"{_BLOCK}, checkpoints array<int>, payload binary"
#: the block number of the row that holds the counts of a task
COUNTS_BLOCK = -1


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` by package-merge; 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.int64)
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids do not fit codes of {max_bits} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    levels, items = [], leaves
    is_leaf = np.ones(len(leaves), dtype=bool)
    for _ in range(max_bits):
        levels.append(is_leaf)
        packages = items[:len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        order = np.argsort(both, kind="stable")
        items, is_leaf = both[order], order < len(leaves)
    taken = 2 * (len(leaves) - 1)
    for is_leaf in reversed(levels):  # of the items taken, the leaves are the rarest ids; each package stands for two of the level below
        n = int(is_leaf[:taken].sum())
        lengths[used[:n]] += 1
        taken = 2 * (taken - n)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of length, then id."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    code, before = 0, 0
    for i in used:
        code <<= int(lengths[i]) - before
        before = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Bit offsets of the checkpoints, and the codes one after another."""
    size = lengths[ids]
    end = np.cumsum(size)
    offset = end - size
    word = offset >> 5
    shifted = codes[ids] << (64 - (offset & 31) - size).astype(np.uint64)
    words = int(end[-1]) // 32 + 2 if len(ids) else 0
    high, low = (shifted >> np.uint64(32)).astype(np.float64), (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64)
    packed = np.bincount(word, high, words) + np.bincount(word + 1, low, words)  # bits of a word are disjoint, and sums below 2^53 exact
    return offset[::CHECKPOINT_IDS].astype(np.int32), packed.astype(">u4").tobytes()[:(int(end[-1]) + 7) // 8 if len(ids) else 0]


class Decoder:
    """Decodes blocks by one table look-up per id."""

    def __init__(self, lengths: np.ndarray):
        self.bits = max(1, int(lengths.max(initial=1)))
        self.symbol = np.zeros(1 << self.bits, dtype=np.uint32)
        self.step = np.ones(1 << self.bits, dtype=np.int64)
        codes = canonical_codes(lengths)
        for i in np.flatnonzero(lengths):
            span = self.bits - int(lengths[i])
            first = int(codes[i]) << span
            self.symbol[first:first + (1 << span)] = i
            self.step[first:first + (1 << span)] = lengths[i]

    def decode(self, payloads: list[bytes], checkpoints: list[np.ndarray], sizes: list[int]) -> list[np.ndarray]:
        bases = np.cumsum([0, *map(len, payloads)])[:-1]
        data = np.frombuffer(b"".join(payloads) + b"\0" * 4, dtype=np.uint8).astype(np.uint32)
        windows = (data[:-3] << np.uint32(16)) | (data[1:-2] << np.uint32(8)) | data[2:-1]
        at = np.concatenate([c.astype(np.int64) + 8 * b for c, b in zip(checkpoints, bases)])
        out = np.zeros((len(at), CHECKPOINT_IDS), dtype=np.uint32)
        mask, last = (1 << self.bits) - 1, len(windows) - 1
        for k in range(CHECKPOINT_IDS):
            peek = (windows[np.minimum(at >> 3, last)] >> (24 - self.bits - (at & 7))) & mask
            out[:, k] = self.symbol[peek]
            at = at + self.step[peek]
        lanes = np.cumsum([0, *map(len, checkpoints)])
        return [out[a:b].reshape(-1)[:n] for a, b, n in zip(lanes, lanes[1:], sizes)]


def _raw_blocks(docs: DataFrame, tokenizer_path: str, drops_white_space: bool, end_id: int, block_ids: int) -> DataFrame:
    """Ids in ascending order of doc_id, in blocks that still have to be coded."""
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = chunked_tokenizer(tokenizer_path, drops_white_space), TaskContext.get().partitionId()
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int32()),
                            ("doc_ids", pa.list_(pa.int64())), ("doc_at", pa.list_(pa.int32())), ("first_doc", pa.int64()),
                            ("continued", pa.bool_()), ("open", pa.bool_()), ("counts", pa.binary()), ("ids", pa.binary())])
        held, names, places, size, block, done, docs_before, continued = [], [], [], 0, 0, 0, 0, False
        counts = np.zeros(0, dtype=np.int64)

        def as_row(values: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

        def row(is_open: bool) -> pa.RecordBatch:
            nonlocal counts
            ids = np.concatenate(held).astype("<u4")
            found = np.bincount(ids, minlength=len(counts))
            found[:len(counts)] += counts
            counts = found
            return as_row([part, block, done, size, names, places, docs_before, continued, is_open, None, ids.tobytes()])

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coder.documents(batch.column("text"), end_id)):
                if size and size + len(ids) > block_ids:  # only a document longer than a block is split
                    yield row(False)
                    block, done, docs_before = block + 1, done + size, docs_before + len(names)
                    held, names, places, size, continued = [], [], [], 0, False
                start = 0
                while start < len(ids):
                    piece = ids[start:start + block_ids - size]
                    names.append(doc_id)
                    places.append(size)
                    held.append(piece)
                    size += len(piece)
                    start += len(piece)
                    if size == block_ids:
                        is_open = start < len(ids)
                        yield row(is_open)
                        block, done, docs_before = block + 1, done + size, docs_before + len(names) - is_open
                        held, names, places, size, continued = [], [], [], 0, is_open
        coder.forget()
        if size:
            yield row(False)
        yield as_row([part, COUNTS_BLOCK, done, 0, [], [], docs_before, False, False, counts.astype("<i8").tobytes(), b""])

    return ordered.mapInArrow(run, _RAW)


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, drops_white_space: bool = False,
                 id_column: str = "doc_id", text_column: str = "text", block_ids: int = BLOCK_IDS, max_bits: int = MAX_BITS) -> None:
    """Write the ids of all whole texts, each followed by ``end_id``, to a token folder."""
    spark = docs.sparkSession
    send_few_rows(spark)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    raw_folder = shared_folder(spark)
    _raw_blocks(rows, tokenizer_path, drops_white_space, end_id, block_ids).write.option("compression", "zstd").parquet(raw_folder)
    raw = spark.read.schema(_RAW).parquet(raw_folder)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column("counts"):
                total = np.frombuffer(packed.as_buffer(), "<i8")
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["id", "n"])

    # the counts of each tokenising task, one row a task
    counted = raw.filter("counts IS NOT NULL").select("counts").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = {r["id"]: r["n"] for r in counted.collect()}  # one row per id of the vocabulary at most
    counts = np.zeros(max(found, default=0) + 1, dtype=np.int64)
    counts[list(found)] = list(found.values())
    lengths = code_lengths(counts, max_bits)
    codes = canonical_codes(lengths)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [encode_block(np.frombuffer(ids.as_buffer(), "<u4"), codes, lengths) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [pa.array([c for c, _ in coded], pa.list_(pa.int32())),
                                                                  pa.array([p for _, p in coded], pa.binary())],
                                             batch.schema.names[:-1] + ["checkpoints", "payload"])

    raw.filter(f"block > {COUNTS_BLOCK}").drop("counts").mapInArrow(encode, _CODED).write.option("compression", "zstd").parquet(f"{folder}/blocks")
    used = np.flatnonzero(lengths)
    codebook = spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, bits int")
    codebook.coalesce(1).write.parquet(f"{folder}/codebook")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids (packed little-endian 32-bit integers)."""
    blocks = spark.read.schema(_CODED).parquet(f"{folder}/blocks")
    book = spark.read.schema("id int, bits int").parquet(f"{folder}/codebook").collect()  # one row per id of the vocabulary at most
    lengths = np.zeros(max((r["id"] for r in book), default=0) + 1, dtype=np.int64)
    lengths[[r["id"] for r in book]] = [r["bits"] for r in book]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for whole in batches:
            for start in range(0, whole.num_rows, DECODE_BLOCKS):
                batch = whole.slice(start, DECODE_BLOCKS)
                rows = batch.select(["part", "block", "first_id", "n_ids", "doc_ids", "doc_at", "first_doc", "continued", "open"]).to_pylist()
                marks = [np.array(c, dtype=np.int32) for c in batch.column("checkpoints").to_pylist()]
                blocks_ids = decoder.decode(batch.column("payload").to_pylist(), marks, [r["n_ids"] for r in rows])
                columns = {n: [] for n in ("part", "block", "doc", "doc_id", "at", "n_tokens", "partial", "ids")}
                for r, ids in zip(rows, blocks_ids):
                    data, edges, n = ids.astype("<u4").tobytes(), [*r["doc_at"], r["n_ids"]], len(r["doc_at"])
                    columns["part"] += [r["part"]] * n
                    columns["block"] += [r["block"]] * n
                    columns["doc"] += range(r["first_doc"], r["first_doc"] + n)
                    columns["doc_id"] += r["doc_ids"]
                    columns["at"] += [r["first_id"] + a for a in r["doc_at"]]
                    columns["n_tokens"] += [b - a for a, b in zip(edges, edges[1:])]
                    columns["partial"] += [(i == 0 and r["continued"]) or (i == n - 1 and r["open"]) for i in range(n)]
                    columns["ids"] += [data[4 * a:4 * b] for a, b in zip(edges, edges[1:])]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns.values(), kinds)], list(columns))

    # the ids of a part before the next one begins: one row per part file
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = F.broadcast(sizes.select("part", before.alias("base")))

    kind = "part int, block int, doc long, doc_id long, at long, n_tokens long, partial boolean, ids binary"
    whole = blocks.mapInArrow(decode, kind).filter("not partial").select("part", "doc_id", "at", "n_tokens", "ids")
    # blocks end with a document: only those of longer documents are decoded for the documents that have to be put together
    split = blocks.filter("continued or open").mapInArrow(decode, kind).filter("partial").groupBy("part", "doc").agg(
        F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n_tokens").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("block", "ids"))).alias("found"))
    joined = F.unhex(F.array_join(F.transform("found", lambda piece: F.hex(piece["ids"])), ""))
    split = split.select("part", "doc_id", "at", "n_tokens", joined.alias("ids"))
    return whole.unionByName(split).join(bases, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")
