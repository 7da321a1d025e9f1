"""Embedding near-dedup by spherical-cap filters.

Vectors are first turned by one fixed random rotation, so that neither an order nor a padding of the coordinates matters. A filter is a
direction made of one random unit code per third of the turned dimensions; a product code of ``CODES`` to the power of ``PARTS``
directions. A vector is list-decoded to all directions whose inner product with it exceeds a threshold, which is set so that a random
vector passes ``FILTERS`` of them; where fewer pass, its best ``LEAST_FILTERS`` are taken. Below ``FEW_DIMENSIONS`` dimensions the filters
are grid cells instead, which no pair above the threshold escapes. Vectors of the same label that share a filter are compared exactly,
in double precision.

Equal vectors are collapsed to one class first. A filter's vectors are compared in pairs of blocks of about ``BLOCK`` rows; a block
pair returns one row per vector, its number of links and one link to the smallest vector of its part, never the pairs. A pair that
shares several filters is counted under the smallest.

Defined results: a vector that is null, empty, zero or holds null or non-finite components, and one whose label or id is null, links
with nothing and is a component of its own. Vectors of different length are not compared. Repeated rows are links of each other.
An empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, stored, with_computed
from .components import components

COSINE = 0.93
PARTS = 3
CODES = 32
FILTERS = 32
LEAST_FILTERS = 24
BLOCK = 512
FEW_DIMENSIONS = 8
CELL_COORDINATES = 5


class CapFilters:
    """The product code for vectors of one dimension."""

    def __init__(self, dim: int, seed: int = 11):
        rng = np.random.default_rng([seed, dim])
        rotation = np.linalg.qr(np.random.default_rng([seed, dim, 1]).standard_normal((dim, dim)))[0]
        self.codes = []
        for turned in np.array_split(rotation, min(PARTS, dim)):
            code = rng.standard_normal((CODES, len(turned)))
            self.codes.append(code / np.linalg.norm(code, axis=1, keepdims=True) @ turned)
        trial = rng.standard_normal((64, dim))
        trial /= np.linalg.norm(trial, axis=1, keepdims=True)
        every = np.stack([self._all(self._parts(v[None, :]))[0] for v in trial])
        passing = min(FILTERS * len(trial), every.size - 1)
        self.threshold = float(-np.partition(-every.ravel(), passing)[passing])

    def _parts(self, unit: np.ndarray) -> list[np.ndarray]:
        return [unit @ code.T for code in self.codes]

    @staticmethod
    def _all(parts: list[np.ndarray]) -> np.ndarray:
        total = parts[0]
        for part in parts[1:]:
            total = (total[:, :, None] + part[:, None, :]).reshape(len(total), -1)
        return total

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """The ids of the filters of each row, ascending: the last part is only added where the others leave a chance."""
        parts = self._parts(unit)
        head, tail = self._all(parts[:-1]) if len(parts) > 1 else np.zeros((len(unit), 1)), parts[-1]
        row, code = np.nonzero(head >= self.threshold - tail.max(axis=1, keepdims=True))
        hit, last = np.nonzero(head[row, code][:, None] + tail[row] >= self.threshold)
        found = np.split(code[hit] * CODES + last, np.searchsorted(row[hit], np.arange(1, len(unit))))
        for i, ids in enumerate(found):
            if len(ids) < LEAST_FILTERS:
                scores = self._all([p[i:i + 1] for p in parts])[0]
                k = min(LEAST_FILTERS, len(scores))
                found[i] = np.sort(np.argpartition(-scores, k - 1)[:k])
        return found


class CellFilters:
    """Grid cells over the first coordinates of vectors of few dimensions.

    A vector takes the cells within half the distance of a link of it, coordinate by coordinate; two linked vectors share the cell of
    their midpoint.
    """

    def __init__(self, dim: int, cosine: float):
        self.coordinates = min(CELL_COORDINATES, dim)
        self.reach = np.sqrt(max(2 - 2 * cosine, 0)) / 2 + 1e-9
        self.width = max(2 * self.reach, 0.05)
        self.base = int((2 + 2 * self.reach) / self.width) + 2

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """The ids of the filters of each row, ascending."""
        x = unit[:, :self.coordinates] + 1 + self.reach
        low, high = (np.floor((x + side) / self.width).astype(np.int64) for side in (-self.reach, self.reach))
        found = []
        for first, last in zip(low, high):
            ids = np.zeros(1, dtype=np.int64)
            for a, b in zip(first, last):
                ids = (ids[:, None] * self.base + np.arange(a, b + 1)).ravel()
            found.append(ids)
        return found


@lru_cache(maxsize=4)
def filters_of(dim: int, cosine: float) -> CapFilters | CellFilters:
    """One per Python worker, dimension and threshold."""
    return CellFilters(dim, cosine) if dim < FEW_DIMENSIONS else CapFilters(dim)


def _sound(values: list | None) -> np.ndarray | None:
    if not values or None in values:
        return None
    vector = np.array(values, dtype=np.float64) + 0.0  # no negative zeros
    return vector if np.isfinite(vector).all() and 0 < float(vector @ vector) < np.inf else None


def _classes(vectors: DataFrame) -> DataFrame:
    """Rows with a digest of the vector; null for those that link with nothing."""
    def make():
        def compute(part):
            sound = [_sound(v) for v in part.column("embedding").to_pylist()]
            return {"dim": [None if v is None else len(v) for v in sound],
                    "digest": [None if v is None else xxhash.xxh3_128_digest(v.tobytes()) for v in sound],
                    "vector": [None if v is None else v.tobytes() for v in sound]}

        return compute

    return with_computed(vectors, "dim int, digest binary, vector binary", make, rows=2048, keep=["vec_id", "label"])


def _with_filters(classes: DataFrame, cosine: float) -> DataFrame:
    def make():
        def compute(part):
            out: list = [None] * part.num_rows
            data, dims = part.column("vector").to_pylist(), np.array(part.column("dim").to_pylist())
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = np.stack([np.frombuffer(data[i], np.float64) for i in at])
                for i, ids in zip(at, filters_of(int(dim), cosine).decode(x / np.linalg.norm(x, axis=1, keepdims=True))):
                    out[i] = ids.astype(np.int32)
            return {"filters": out}

        return compute

    return with_computed(classes, "filters array<int>", make, rows=64)


def _compared(key: tuple, rows: pa.Table) -> pa.Table:
    """One pair of blocks of one filter: per class the weight of its links, and a link to the smallest class of its part."""
    here, first, second = key[2].as_py(), key[3].as_py(), key[4].as_py()
    cid, size = rows.column("cid").to_numpy(), rows.column("class_size").to_numpy()
    x = np.stack([np.frombuffer(v.as_buffer(), np.float64) for v in rows.column("vector")])
    norm = np.linalg.norm(x, axis=1)
    linked = (x @ x.T) / (norm[:, None] * norm[None, :]) >= rows.column("cosine")[0].as_py()
    np.fill_diagonal(linked, False)
    if first != second:
        block = rows.column("block").to_numpy()
        linked &= block[:, None] != block[None, :]
    schema = pa.schema([("cid", pa.int64()), ("weight", pa.int64()), ("root", pa.int64())])
    at = np.flatnonzero(linked.any(axis=1))
    if not len(at):
        return schema.empty_table()
    linked, cid, size = linked[np.ix_(at, at)], cid[at], size[at]
    filters = [np.array(f.as_py(), dtype=np.int64) for f in rows.column("filters").take(pa.array(at))]
    earlier = [f[f < here] for f in filters]
    names = np.unique(np.concatenate(earlier))
    member = np.zeros((len(at), len(names)), dtype=np.float32)
    for row, f in zip(member, earlier):
        row[np.searchsorted(names, f)] = 1
    counted = linked & (member @ member.T == 0)
    root = cid.copy()
    while True:
        lower = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (lower == root).all():
            break
        root = lower
    return pa.table([cid, counted @ size, root], schema=schema)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_column: str = "vec_id", vector_column: str = "embedding",
                    label_column: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("embedding"), F.col(label_column).alias("label"))
    read = stored(_classes(rows))
    valid = "digest IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL"
    key = ["label", "dim", "digest"]
    classes = read.filter(valid).groupBy(*key).agg(F.min("vec_id").alias("cid"), F.count("*").alias("class_size"), F.first("vector").alias("vector"))
    filtered = stored(_with_filters(classes, cosine))

    postings = filtered.select("label", "dim", "cid", F.explode("filters").alias("filter"))
    bucket = ["label", "dim", "filter"]
    crowded = stored(postings.groupBy(*bucket).agg(F.count("*").alias("n")).filter("n > 1"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = (postings.join(crowded, bucket).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select(*bucket, "cid", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second")))
    full = stored(placed).join(filtered.select("cid", "class_size", "vector", "filters"), "cid").withColumn("cosine", F.lit(cosine))
    compared = stored(full.groupBy(*bucket, "first", "second").applyInArrow(_compared, "cid long, weight long, root long"))

    weights = compared.groupBy("cid").agg(F.sum("weight").alias("weight"))
    parts = components(compared.filter("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")).distinct())
    named = (filtered.select(*key, "cid", "class_size").join(weights, "cid", "left").join(parts.withColumnRenamed("node", "cid"), "cid", "left"))
    n_links = F.col("class_size") - 1 + F.coalesce("weight", F.lit(0))
    named = stored(named.select(*key, "class_size", n_links.alias("n_links"), F.coalesce("component", "cid").alias("component_id")))
    members = join_groups(read.filter(valid).select("vec_id", *key), named, key, "class_size").select("vec_id", "n_links", "component_id")
    alone = read.filter(f"NOT ({valid})").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return members.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
