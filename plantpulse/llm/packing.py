"""Best-fit packing after Martello-Toth dominance reduction.

Lengths are whole numbers up to the capacity, so an instance is a histogram with at most ``capacity`` entries, however many documents
there are. The reduction fixes sets of pieces that provably dominate every other set with the same piece (a pair that fills a sequence;
a pair when no three fit or no two others beat the partner; a triple by the same reasoning), many copies at a time, and removes them.
What remains is packed best-fit in descending order, again many copies at a time. The plan, a list of patterns, is a small table that
says where the r-th piece of each length goes; ranks are counted per task and offset, so no length is gathered anywhere.

Defined results: a null text counts as empty; an empty text is one piece with the end id. Repeated rows are packed as often as they
occur. Rows with a null id are packed like others. An empty table gives no pieces. A text longer than the capacity is cut into whole
sequences behind a first, possibly shorter piece.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import send_few_rows, stored
from .tokens import chunked_tokenizer

CAPACITY = 2048

#: sizes of a sequence's pieces with their multiplicity, and how many sequences look so
Pattern = tuple[dict[int, int], int]


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, drops_white_space: bool = False, capacity: int = CAPACITY,
                 id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, part and rank (of the piece among those of its length in its part).

    ``with_ids`` adds the packed ids, for ``sequences``.
    """
    send_few_rows(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    kinds = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "part": pa.int32(), "rank": pa.int64()}
    kinds |= {"ids": pa.binary()} if with_ids else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = chunked_tokenizer(tokenizer_path, drops_white_space), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                out, owner = {name: [] for name in kinds}, []
                for i, ids in enumerate(coder.documents(batch.column("text"), end_id)):
                    edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        data = ids[a:b].tobytes()
                        owner.append(i)
                        values = (k, a, b - a, zlib.crc32(data), part, int(seen[b - a]), data)
                        for name, value in zip(kinds, values):
                            out[name].append(value)
                        seen[b - a] += 1
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner, pa.int32()))]
                                                 + [pa.array(v, kinds[n]) for n, v in out.items()], ["doc_id", *kinds])
        chunked_tokenizer.cache_clear()  # the worker may go on with something else

    ids = ", ids binary" if with_ids else ""
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long{ids}")


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Fixed sequences, each part of some best packing, and the counts that remain."""
    left, fixed = {s: n for s, n in counts.items() if n}, []

    def fix(sizes: tuple[int, ...]) -> None:
        need = {s: sizes.count(s) for s in sizes}
        times = min(left[s] // k for s, k in need.items())
        fixed.append((need, times))
        for s, k in need.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]

    def dominating(j: int, order: list[int]) -> tuple[int, ...] | None:
        """A set with ``j`` that dominates all other feasible sets with ``j``. ``order``: the sizes left, ascending."""
        spare = {s: left[s] - (s == j) for s in order if left[s] > (s == j)}
        room = capacity - j
        sizes = [s for s in order if s in spare]
        at = bisect_left(sizes, room + 1)
        if not at:
            return (j,)
        k = sizes[at - 1]
        if k == room:
            return (j, k)  # fills the sequence, and whatever fits beside j fits where k was
        smallest = [s for s in sizes[:3] for _ in range(min(spare[s], 3))][:3]
        if len(smallest) < 2 or smallest[0] + smallest[1] > room:
            return (j, k)  # j has at most one companion, and none is larger than k
        if len(smallest) == 3 and sum(smallest) <= room:
            return None  # sets of four: not examined
        best = 0  # the largest sum of two companions
        for x in sizes[:at]:
            y_at = bisect_left(sizes, room - x + 1)
            while y_at and (y := sizes[y_at - 1]) and y == x and spare[x] < 2:
                y_at -= 1
            if y_at:
                best = max(best, x + sizes[y_at - 1])
        if best <= k:
            return (j, k)
        b_at = bisect_left(sizes, room - k + 1)
        while b_at and sizes[b_at - 1] == k and spare[k] < 2:
            b_at -= 1
        if b_at:
            b = sizes[b_at - 1]
            above = [s for s in sizes[b_at:b_at + 2] for _ in range(min(spare[s], 2))][:2]
            if len(above) < 2 or sum(above) > room:
                return (j, k, b)  # of two companions one is at most b and the other at most k
        return None

    changed = True
    while changed and left:
        changed = False
        for j in sorted(left, reverse=True):
            while j in left and (found := dominating(j, sorted(left))):
                fix(found)
                changed = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit in descending order of size; equal sequences are kept together with their number."""
    groups: dict[int, list[Pattern]] = {}
    rooms: list[int] = []  # ascending

    def put(room: int, sizes: dict[int, int], times: int) -> None:
        if room not in groups:
            insort(rooms, room)
        groups.setdefault(room, []).append((sizes, times))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            at = bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                sizes, times = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, sizes, times = capacity, {}, n  # new sequences, as many as are used
            each = room // s  # the tightest sequence stays the tightest until no further piece fits
            full = min(times, n // each)
            rest = min(n - full * each, each) if full < times else 0
            if full:
                put(room - each * s, sizes | {s: sizes.get(s, 0) + each}, full)
            if rest:
                put(room - rest * s, sizes | {s: sizes.get(s, 0) + rest}, 1)
            if sizes and (unused := times - full - (rest > 0)):
                put(room, sizes, unused)
            n -= full * each + rest
    return [pattern for same in groups.values() for pattern in same]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, left = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(left, capacity)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a stored table) with sequence_id and offset. At most ``capacity`` counts reach the driver."""
    per_part = stored(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, used, first = [], dict.fromkeys(counts, 0), 0
    for sizes, times in plan(counts, capacity):
        offset = 0
        for s, k in sorted(sizes.items(), reverse=True):
            slots.append((s, used[s], times, first, offset))
            used[s] += k * times
            offset += k * s
        first += times
    slots.sort()
    length, start, times, sequence, offset = (np.array(c, dtype=np.int64) for c in (zip(*slots) if slots else ((),) * 5))
    most = max(counts.values(), default=0) + 1
    key = length * most + start

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("length").to_numpy()
            rank = batch.column("base").to_numpy() + batch.column("rank").to_numpy()
            slot = np.searchsorted(key, size * most + rank, side="right") - 1
            turn = rank - start[slot]
            names = [n for n in batch.schema.names if n not in ("base", "rank", "part")]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [
                pa.array(sequence[slot] + turn % times[slot]), pa.array(offset[slot] + turn // times[slot] * size)], names + ["sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    bases = stored(per_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))).drop("n"))
    ranked = pieces.join(bases, ["length", "part"])
    kept = [f for f in pieces.schema if f.name not in ("part", "rank")]
    ranked = ranked.select(*[f.name for f in kept], "part", "rank", "base")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, length and packed ids. A sequence has at most ``capacity`` pieces."""
    found = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.unhex(F.array_join(F.transform(found, lambda piece: F.hex(piece["ids"])), ""))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))


def packed_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(stored(token_pieces(docs, tokenizer_path, end_id, capacity=capacity)), capacity)
