"""Compressed vector codes: one codebook per part of a vector, nearest entries found by equal-average search.

A component x counts as the whole number floor(``SCALE`` * x). The entries of a codebook are sorted by the sum of their components. Of
two vectors of d components whose sums differ by g, the squared distance is at least g * g / d. The search for the nearest entry of a
part starts at the entry of nearest sum and goes outward on both sides, until g * g / d strictly exceeds the best distance so far: an
entry at the same distance may still have a lower index. Parts of similar sum are searched together, a few entries at a time.

Vectors stay where they are; a round of the fit sends the codebooks (at most entries x dimension numbers) to the tasks, which send back
counts and component sums per entry, added up by a shuffle of at most parts x entries rows a task.

Defined results: rows whose vector is null or holds null or non-finite components are dropped. All others are coded, those with a null
or repeated id or a null label too; rows with null labels are one label, null ids come last among the rows that start the codebooks, and
of equal ids the smaller vector comes first. A codebook has fewer entries where fewer vectors are kept. All vectors are expected to have
as many components as the first; rows with another number get a null code and null errors and take no part. Where the number of
components is no multiple of the number of parts, the first parts are longer by one; empty vectors have empty parts. Whole numbers
beyond 62 bits and errors beyond a long are held at these limits; all sums are exact. An empty table gives no rows and empty codebooks.
Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from .common import join_groups, send_few_rows, stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: parts that are searched together, and entries that are compared with them at a time
PARTS_AT_ONCE = 256
ENTRIES_AT_ONCE = 16
#: whole numbers are held at this limit
LIMIT = 1 << 62
LONG_MAX = (1 << 63) - 1

#: a part's entries as rows of whole numbers
Codebook = np.ndarray


def whole_numbers(values: list | None, scale: int = SCALE) -> np.ndarray | None:
    """floor(scale * x) of each component, or None for a vector that is dropped."""
    if values is None or None in values:
        return None
    x = np.array(values, dtype=np.float64)
    if not np.isfinite(x).all():
        return None
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    return np.clip(scaled, -float(LIMIT), float(LIMIT)).astype(np.int64)


def part_edges(dim: int, parts: int) -> list[int]:
    """Where the parts of a vector begin, and its end."""
    sizes = [dim // parts + (k < dim % parts) for k in range(parts)]
    return [sum(sizes[:k]) for k in range(parts + 1)]


def squared_distances(x: np.ndarray, entries: Codebook) -> np.ndarray:
    """All distances between rows of whole numbers, exact: in doubles or 64 bits where these hold every step, else in Python's integers."""
    widest = max((int(abs(v).max()) for v in (x, entries) if v.size), default=0)
    bound = 4 * widest * widest * max(1, x.shape[1])
    if bound < 1 << 53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    kind = np.int64 if bound < 1 << 63 else object
    gaps = x.astype(kind)[:, None, :] - entries.astype(kind)[None, :, :]
    return (gaps * gaps).sum(axis=2)


class EqualAverageSearch:
    """Nearest entries of one codebook, ties to the lower index."""

    def __init__(self, entries: Codebook):
        exact = entries.astype(np.int64 if _narrow(entries) else object)
        sums = exact.sum(axis=1)
        self.order = np.argsort(sums, kind="stable")
        self.entries, self.sums, self.dim = entries[self.order], sums[self.order], entries.shape[1]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row."""
        wide = not (_narrow(x) and self.sums.dtype != object)
        sums = x.astype(object if wide else np.int64).sum(axis=1) if self.dim else np.zeros(len(x), np.int64)
        index, best = np.zeros(len(x), np.int64), np.zeros(len(x), object if wide else np.int64)
        by_sum = np.argsort(sums, kind="stable")
        for start in range(0, len(x), PARTS_AT_ONCE):
            rows = by_sum[start:start + PARTS_AT_ONCE]
            index[rows], best[rows] = self._outward(x[rows], sums[rows])
        return index, best

    def _outward(self, x: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = int(np.searchsorted(self.sums, sums[len(sums) // 2]))
        low = max(0, min(at - ENTRIES_AT_ONCE // 2, len(self.sums) - ENTRIES_AT_ONCE))
        high = min(len(self.sums), low + ENTRIES_AT_ONCE)
        index = np.full(len(x), len(self.sums), np.int64)
        best: np.ndarray | None = None
        best, index = self._better(x, low, high, best, index)
        best = best.astype(sums.dtype, copy=False)  # distances may fit 64 bits where their multiples do not
        below = above = np.arange(len(x))
        while True:
            if low > 0:
                gap = sums[below] - self.sums[low - 1]
                below = below[(gap < 0) | (gap * gap <= best[below] * self.dim)]
            if high < len(self.sums):
                gap = self.sums[high] - sums[above]
                above = above[(gap < 0) | (gap * gap <= best[above] * self.dim)]
            if not (low > 0 and len(below) or high < len(self.sums) and len(above)):
                return index, best
            if low > 0 and len(below):
                step = max(0, low - ENTRIES_AT_ONCE)
                best[below], index[below] = self._better(x[below], step, low, best[below], index[below])
                low = step
            if high < len(self.sums) and len(above):
                step = min(len(self.sums), high + ENTRIES_AT_ONCE)
                best[above], index[above] = self._better(x[above], high, step, best[above], index[above])
                high = step

    def _better(self, x: np.ndarray, low: int, high: int, best: np.ndarray | None, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best of the entries low to high and what was the best before."""
        by_index = np.argsort(self.order[low:high], kind="stable") + low
        distances = squared_distances(x, self.entries[by_index])
        if distances.dtype == object:
            at = np.array([min(range(len(by_index)), key=row.__getitem__) for row in distances], dtype=np.int64)
        else:
            at = distances.argmin(axis=1)
        found, of = distances[np.arange(len(x)), at], self.order[by_index[at]]
        if best is None:
            return found, of
        taken = (found < best) | (found == best) & (of < index)
        return np.where(taken, found, best), np.where(taken, of, index)


def _narrow(x: np.ndarray) -> bool:
    """Whether squares of gaps of component sums stay within 64 bits."""
    widest = int(abs(x).max()) if x.size else 0
    return (2 * widest * max(1, x.shape[1])) ** 2 < 1 << 62


def kept_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", scale: int = SCALE) -> DataFrame:
    """vec_id, label, no_label, dim and the whole numbers as packed 64-bit integers of each row that is not dropped."""
    send_few_rows(vectors.sparkSession)
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(label_column).alias("label"), F.col(vector_column).alias("embedding"))
    schema = rows.select("vec_id", "label", F.lit(True).alias("no_label"), F.lit(0).alias("dim"), F.lit(b"").alias("numbers")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [whole_numbers(v.as_py(), scale) for v in batch.column("embedding")]
            at = [i for i, v in enumerate(found) if v is not None]
            part = batch.take(pa.array(at, pa.int64()))
            label = part.column("label")
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), label, label.is_null(), pa.array([len(found[i]) for i in at], pa.int32()),
                                              pa.array([found[i].astype("<i8").tobytes() for i in at], pa.binary())], list(schema.names))

    return rows.mapInArrow(run, schema)


def _matrix(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``dim`` components, and their numbers."""
    at = np.flatnonzero(batch.column("dim").to_numpy() == dim)
    data = b"".join(batch.column("numbers").take(pa.array(at)).to_pylist())
    return at, np.frombuffer(data, "<i8").reshape(len(at), dim)


def starting_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> list[Codebook]:
    """The parts of the first vectors by id. Bounded: ``entries`` vectors come to the driver."""
    first = kept.select("vec_id", "dim", "numbers").orderBy(F.col("vec_id").asc_nulls_last(), "numbers")
    head = first.limit(1).collect()
    if not head:
        return [np.zeros((0, 0), np.int64) for _ in range(parts)]
    dim = head[0]["dim"]
    rows = first.filter(F.col("dim") == dim).limit(entries).collect()
    x = np.frombuffer(b"".join(bytes(r["numbers"]) for r in rows), "<i8").reshape(len(rows), dim)
    edges = part_edges(dim, parts)
    return [x[:, a:b] for a, b in zip(edges, edges[1:])]


def refined_codebooks(kept: DataFrame, codebooks: list[Codebook]) -> list[Codebook]:
    """One round: parts go to their nearest entries, which become the floors of the means; entries without parts stay."""
    dim = sum(c.shape[1] for c in codebooks)
    edges = part_edges(dim, len(codebooks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [EqualAverageSearch(c) for c in codebooks]
        counts = [np.zeros(len(c), np.int64) for c in codebooks]
        sums = [np.zeros(c.shape, object) for c in codebooks]
        for batch in batches:
            _, x = _matrix(batch, dim)
            for k, search in enumerate(searches):
                own = x[:, edges[k]:edges[k + 1]]
                index, _ = search.nearest(own)
                counts[k] += np.bincount(index, minlength=len(counts[k]))
                total = np.zeros(sums[k].shape, np.int64 if _narrow(own) else object)
                np.add.at(total, index, own.astype(total.dtype))
                sums[k] += total
        for k, count in enumerate(counts):
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), k), pa.int32()), pa.array(used, pa.int32()), pa.array(count[used], pa.int64()),
                 pa.array([[Decimal(int(v)) for v in sums[k][e]] for e in used], pa.list_(pa.decimal128(38, 0)))], ["part", "entry", "n", "sums"])

    partial = kept.select("dim", "numbers").mapInArrow(run, "part int, entry int, n long, sums array<decimal(38,0)>")
    longest = max(c.shape[1] for c in codebooks)
    total = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i)).cast(DecimalType(38, 0))).alias(f"s{i}") for i in range(longest)])
    out = [c.copy() for c in codebooks]
    for row in total.collect():
        book = out[row["part"]]
        book[row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(book.shape[1])]
    return out


def fitted_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[Codebook]:
    codebooks = starting_codebooks(kept, parts, entries)
    if len(codebooks[0]):
        for _ in range(rounds):
            codebooks = refined_codebooks(kept, codebooks)
    return codebooks


def with_codes(kept: DataFrame, codebooks: list[Codebook]) -> DataFrame:
    """The rows of ``kept`` without their numbers: vec_id, label, no_label, code (indexes in hex, as many digits as the codebooks need) and error."""
    dim = sum(c.shape[1] for c in codebooks)
    edges = part_edges(dim, len(codebooks))
    digits = max(2, len(f"{max(1, len(codebooks[0])) - 1:x}"))
    schema = kept.select("vec_id", "label", "no_label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).schema
    for name in ("code", "error"):
        schema[name].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [EqualAverageSearch(c) for c in codebooks]
        for batch in batches:
            at, x = _matrix(batch, dim)
            code: list[str | None] = [None] * batch.num_rows
            error: list[int | None] = [None] * batch.num_rows
            found = [search.nearest(x[:, edges[k]:edges[k + 1]]) for k, search in enumerate(searches)]
            for j, i in enumerate(at):
                code[i] = "".join(f"{index[j]:0{digits}x}" for index, _ in found)
                error[i] = min(LONG_MAX, sum(int(best[j]) for _, best in found))
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("vec_id", "label", "no_label")), pa.array(code, pa.string()), pa.array(error, pa.int64())], list(schema.names))

    return kept.mapInArrow(run, schema)


def decoded(codes: DataFrame, codebooks: list[Codebook], scale: int = SCALE, code_column: str = "code", vector_column: str = "decoded") -> DataFrame:
    """``codes`` with the vectors that the codes stand for, as doubles; null codes decode to null."""
    from .common import with_computed

    digits = max(2, len(f"{max(1, len(codebooks[0])) - 1:x}"))

    def make():
        def vector(code: str | None):
            if code is None:
                return None
            at = [int(code[i:i + digits], 16) for i in range(0, len(code), digits)]
            return (np.concatenate([book[i] for book, i in zip(codebooks, at)]) / scale).tolist()

        return lambda part: {vector_column: [vector(c) for c in part.column(code_column).to_pylist()]}

    return with_computed(codes, f"`{vector_column}` array<double>", make, rows=4096)


def codebooks_digest(codebooks: list[Codebook]) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for book in codebooks for v in book.ravel()).encode()).hexdigest()


def coded_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_column: str = "vec_id",
                  vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error and codebooks_sha256."""
    kept = stored(kept_vectors(vectors, id_column, vector_column, label_column, scale))
    codebooks = fitted_codebooks(kept, parts, entries, rounds)
    of_nothing = F.coalesce("label", F.lit(0).cast(kept.schema["label"].dataType))  # null labels meet under no_label
    codes = stored(with_codes(kept, codebooks).withColumn("label", of_nothing))
    key = ["label", "no_label"]
    total = F.sum(F.col("error").cast(DecimalType(38, 0)))
    total = F.when(total > LONG_MAX, LONG_MAX).otherwise(total.cast("long"))
    labels = stored(codes.groupBy(*key).agg(total.alias("label_error"), F.count("*").alias("n")))
    return join_groups(codes, labels, key, "n").select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"))
