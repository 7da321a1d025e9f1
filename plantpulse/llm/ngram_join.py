"""N-gram Jaccard self-join: a grouped prefix join over word shingles.

1. The document frequencies of all shingles are added up in a table of fixed size (``FREQUENCY_BUCKETS``). It only serves to order the
   shingles, rarest bucket first, then by hash; any one order gives the same links.
2. Of each document the prefix is taken: so many of its first shingles that two linked documents must share one of them. Documents with
   the same prefix and size make one group, and a group's members with the same set make one class.
3. Lists, the groups that share a prefix shingle, are gathered in bundles: a bundle is named by the smallest group of its lists, so that
   the similar lists of one family fall together and each two groups that share a list share a bundle. Bundles are cut into cells by size
   and hash; all work on a pair of cells is done in one task, where overlaps are products of sparse rows, and no pair is ever a row.
4. First the groups of a pair of cells are filtered: by size, and by the shingles that both prefixes hold, beyond which only so many can
   follow. Groups left with a partner are then expanded to their classes and verified on the whole sets. A pair of cells returns one row
   per linked class: one link of its component, and the documents that its links lead to; each link is counted in one bundle.

Shingles are 64-bit hashes of five words. Defined results: a null text or one without words has no shingles, and is a component of its
own; a text of fewer words than a shingle has one shingle, all its words. Rows with a null id link to nothing and have a null component.
Repeated rows are members of one class. Other columns of the input are not read. Texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, member_bits, send_few_rows, stored, with_computed, with_membership
from .components import components

WORDS = 5
#: a link: 100 * intersection >= PERCENT * union
PERCENT = 80
#: about the most classes and shingles of a cell; columns of a product of two cells
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
_COLUMNS = 4096
#: sizes of linked sets differ by a factor of at most 100 / PERCENT; a little more is safe against rounding
BAND = 1.008 * 100 / PERCENT
FREQUENCY_BUCKETS = 1 << 20
_SLICES = 64
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes. Words are what stands between U+0020 and U+0009 to U+000D; A-Z count as a-z."""
    words = (text or "").encode().lower().split()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if not words:
        return hashes
    n = max(1, len(words) - WORDS + 1)
    total = np.full(n, len(words) if len(words) < WORDS else 0, dtype=np.uint64)
    for k in range(min(WORDS, len(words))):
        total += hashes[k:k + n] * _WEIGHTS[k]
    return np.unique(_mixed(total))


def frequency_table(docs: DataFrame) -> np.ndarray:
    """How many documents have a shingle in each bucket, over all documents; of fixed size."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(FREQUENCY_BUCKETS, dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                sets = [shingle_set(t) for t in batch.column("text").slice(start, 256).to_pylist()]
                counts += np.bincount((np.concatenate(sets) & np.uint64(FREQUENCY_BUCKETS - 1)).astype(np.int64), minlength=FREQUENCY_BUCKETS)
        parts = counts.reshape(_SLICES, -1)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column("slice").to_pylist(), batch.column("counts")):
                sums[i] = sums.get(i, 0) + np.frombuffer(counts.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["slice", "counts"])

    send_few_rows(docs.sparkSession)
    kind = "slice int, counts binary"
    found = docs.select("text").mapInArrow(count, kind).repartition("slice").mapInArrow(add, kind).collect()
    table = np.zeros((_SLICES, FREQUENCY_BUCKETS // _SLICES), dtype=np.int64)
    for row in found:
        table[row["slice"]] = np.frombuffer(row["counts"], np.int64)
    return np.minimum(table.reshape(-1), 2**32 - 1).astype(np.uint32)


def signatures(docs: DataFrame, frequencies: np.ndarray) -> DataFrame:
    """doc_id, text_key, n_shingles, two hashes of the whole set, the hash of the prefix, and the prefix in order."""
    shared = docs.sparkSession.sparkContext.broadcast(frequencies)

    def make():
        table = shared.value

        def compute(part):
            out = {"n_shingles": [], "sig1": [], "sig2": [], "prefix_sig": [], "prefix": []}
            for text in part.column("text").to_pylist():
                x = shingle_set(text)
                n = len(x)
                order = np.lexsort((x, table[(x & np.uint64(FREQUENCY_BUCKETS - 1)).astype(np.int64)]))
                prefix = x[order[:n - (PERCENT * n + 99) // 100 + 1]] if n else x
                folded = [_mixed(x).sum(dtype=np.uint64), _mixed(x ^ _WEIGHTS[0]).sum(dtype=np.uint64), _mixed(prefix ^ _WEIGHTS[1]).sum(dtype=np.uint64)]
                for name, value in zip(out, (n, *(int(v.astype(np.int64)) for v in folded), prefix.view(np.int64))):
                    out[name].append(value)
            return out

        return compute

    return with_computed(docs, "n_shingles long, sig1 long, sig2 long, prefix_sig long, prefix array<long>", make, keep=["doc_id", "text_key"])


def _shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share."""
    counts = np.zeros((len(sets), len(sets)), dtype=np.int64)
    shingles, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    kept = often[column] > 1
    row, column = row[kept], np.cumsum(often > 1)[column[kept]] - 1
    for start in range(0, int((often > 1).sum()), _COLUMNS):
        a, b = np.searchsorted(column, (start, start + _COLUMNS))
        member = np.zeros((len(sets), _COLUMNS), dtype=np.float32)
        member[row[a:b], column[a:b] - start] = 1
        counts += (member @ member.T).astype(np.int64)
    return counts


def _possible(key: tuple, rows: pa.Table) -> pa.Table:
    """One pair of cells of a bundle: the groups that have a partner by size and by the shared shingles of their prefixes.

    What follows a prefix can add at most its own number of shingles to those that both prefixes hold.
    """
    n, units = rows.column("n").to_numpy(), rows.column("g").to_numpy()
    rest = (PERCENT * n + 99) // 100 - 1
    reach = _shared_counts(_arrays(rows.column("listed"))) + np.maximum(rest[:, None], rest[None, :])
    possible = (100 + PERCENT) * reach >= PERCENT * (n[:, None] + n[None, :])
    possible &= 100 * np.minimum(n[:, None], n[None, :]) >= PERCENT * np.maximum(n[:, None], n[None, :])
    possible |= units[:, None] == units[None, :]
    np.fill_diagonal(possible, rows.column("classes").to_numpy() > 1)
    if key[1].as_py() != key[2].as_py():
        cell = rows.column("cell").to_numpy()
        possible &= cell[:, None] != cell[None, :]
    return rows.filter(pa.array(possible.any(axis=1))).select(["bundle", "first", "second", "cell", "g", "part", "bundles"])


def _smallest_reached(linked: np.ndarray) -> np.ndarray:
    """Per row the smallest row that links lead to."""
    label = np.arange(len(linked))
    while True:
        lower = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1))
        lower = lower[lower]
        if np.array_equal(lower, label):
            return label
        label = lower


def _verified(key: tuple, rows: pa.Table) -> pa.Table:
    """One pair of cells of a bundle, whole sets: per linked class the smallest document that its links lead to here, and the number of
    documents that its links lead to. Two classes may meet in several bundles; their link is counted in the smallest of these."""
    names = np.stack([rows.column(c).to_numpy() for c in ("cid", "sig1", "sig2")], axis=1)
    rows = rows.take(pa.array(np.unique(names, axis=0, return_index=True)[1]))  # by ascending cid; a repeated row brings its set again
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("shingles")]
    n, bundle = np.array([len(x) for x in sets]), key[0].as_py()
    shared = _shared_counts(sets)
    linked = 100 * shared >= PERCENT * (n[:, None] + n[None, :] - shared)
    np.fill_diagonal(linked, False)
    if key[1].as_py() != key[2].as_py():
        cell = rows.column("cell").to_numpy()
        linked &= cell[:, None] != cell[None, :]
    counted = linked & (_shared_counts([x[x < bundle] for x in _arrays(rows.column("bundles"))]) == 0)
    weight = counted @ rows.column("class_size").to_numpy()
    to = rows.column("cid").to_numpy()[_smallest_reached(linked)]
    found = pa.table([rows.column("cid"), rows.column("sig1"), rows.column("sig2"), pa.array(weight, pa.int64()), pa.array(to, pa.int64())],
                     ["cid", "sig1", "sig2", "weight", "to"])
    return found.filter(pa.array(linked.any(axis=1)))


def _parts(classes: Column) -> Column:
    return F.ceil(classes / BLOCK).cast("int")


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [x.values.to_numpy() for x in column]


def _placed(members: DataFrame) -> DataFrame:
    """Members of bundles in all pairs of cells that they belong to: columns first, second and their own cell.

    A band of sizes holds no two sizes that differ by more than a factor of ``BAND``, so that linked sets lie in one band or in adjacent
    ones. A band of a bundle is cut into cells of about ``BLOCK`` classes and ``BLOCK_SHINGLES`` shingles.
    """
    members = stored(members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(BAND)).cast("int")))
    bands = members.groupBy("bundle", "band").agg(F.sum("classes").alias("m"), F.sum(F.col("classes") * F.col("n")).alias("shingles"))
    cells = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    bundles = bands.groupBy("bundle").agg(F.map_from_entries(F.collect_list(F.struct("band", cells))).alias("cells"), F.sum("m").alias("m"))
    rows = join_groups(members, stored(bundles.filter("m > 1")), ["bundle"], "m")

    def cell(band: Column, number: Column) -> Column:
        return band.cast("long") * F.lit(1 << 32) + number

    def of_band(band: Column) -> Column:
        held = F.element_at("cells", band)  # null where the bundle has no such band
        return F.when(held.isNull(), F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(F.coalesce(held, F.lit(1)), F.lit(1)) - 1), lambda i: cell(band, i)))

    near = F.concat(*(of_band(F.col("band") + step) for step in (-1, 0, 1)))
    own = cell(F.col("band"), F.pmod(F.xxhash64("g", "part"), F.element_at("cells", F.col("band"))))
    paired = rows.withColumn("cell", own).withColumn("other", F.explode(near))
    return (paired.withColumns({"first": F.least("cell", "other"), "second": F.greatest("cell", "other")})
            .drop("band", "cells", "m", "other"))


def _links(texts: DataFrame, lists: DataFrame, groups: DataFrame, classes: DataFrame) -> DataFrame:
    """Per class and pair of cells in which it is linked: cid, sig1, sig2, weight, to (see ``_verified``)."""
    pivots = stored(lists.groupBy("shingle").agg(F.min("g").alias("bundle")))
    mixed = groups.filter("classes > 1").select("g", F.lit(None).cast("long").alias("shingle"), F.col("g").alias("bundle"))
    of_group = lists.join(pivots, "shingle").select("g", "shingle", "bundle").unionByName(mixed).groupBy("g").agg(
        F.collect_set("shingle").alias("listed"), F.collect_set("bundle").alias("bundles"))
    parts = _parts(F.col("classes"))
    members = of_group.join(groups.select("g", "n", "classes"), "g").select(
        "g", "n", F.ceil(F.col("classes") / parts).alias("classes"), "listed", "bundles", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    members = members.withColumn("bundle", F.explode("bundles"))
    key = ["bundle", "first", "second"]
    names = ", ".join(f"{c} long" for c in (*key, "cell", "g"))
    possible = stored(_placed(members).groupBy(*key).applyInArrow(_possible, f"{names}, part int, bundles array<bigint>"))

    expanded = stored(possible.join(classes.select("g", "part", "cid", "text_key", "sig1", "sig2", "class_size"), ["g", "part"]).drop("g", "part"))
    likely = with_membership(texts, F.col("doc_id"), member_bits(expanded, "cid"), "_likely").filter("_likely")

    def make():
        return lambda part: {"shingles": [shingle_set(t).tobytes() for t in part.column("text").to_pylist()]}

    # the text of a class moves once, and its set is made where it meets the list of the cells that need it
    own = ["cid", "text_key"]
    once = likely.select(F.col("doc_id").alias("cid"), "text_key", "text").groupBy(*own).agg(F.first("text").alias("text"))
    held = expanded.groupBy(*own).agg(*[F.first(c).alias(c) for c in ("sig1", "sig2", "class_size", "bundles")],
                                      F.collect_list(F.struct(*key, "cell")).alias("places"))
    of_class = ["cid", "sig1", "sig2", "class_size", "bundles"]
    sets = with_computed(held.join(once, own), "shingles binary", make, keep=[*of_class, "places"])
    verified = sets.select(*of_class, "shingles", F.inline("places")).groupBy(*key).applyInArrow(
        _verified, "cid long, sig1 long, sig2 long, weight long, to long")
    return stored(verified)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (smallest id with the same set), component_id (smallest id by links), n_links.

    ``n_links`` is the number of other documents that the document is linked to, those of its class among them. Ids are whole numbers.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    texts = texts.withColumn("text_key", F.xxhash64("text"))
    signed = stored(signatures(texts, frequency_table(texts)))
    full = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")

    key = ["n_shingles", "prefix_sig", "sig1", "sig2"]
    classes = stored(full.groupBy(*key).agg(F.min("doc_id").alias("cid"), F.min_by("text_key", "doc_id").alias("text_key"), F.count("*").alias("class_size"))
                     .withColumn("g", F.xxhash64("n_shingles", "prefix_sig")))
    groups = stored(classes.groupBy("g", F.col("n_shingles").alias("n"), "prefix_sig").agg(F.min("cid").alias("gid"), F.count("*").alias("classes")))

    # lists: the groups that share a prefix shingle. Bits of fixed size tell which documents stand for a group and which shingles are
    # shared; the joins behind them are exact
    standing = with_membership(full, F.col("doc_id"), member_bits(groups, "gid"), "_likely").filter("_likely")
    posts = standing.select(F.explode("prefix").alias("shingle"), F.col("doc_id").alias("gid"), F.col("n_shingles").alias("n"), "prefix_sig")
    shared = stored(posts.groupBy("shingle").agg(F.count("*").alias("groups")).filter("groups > 1"))
    likely = with_membership(posts, F.col("shingle"), member_bits(shared, "shingle"), "_likely").filter("_likely").drop("_likely")
    lists = stored(likely.join(shared.select("shingle"), "shingle").join(groups, ["gid", "n", "prefix_sig"]).select("shingle", "g"))

    split = classes.join(groups.select("g", "classes"), "g").withColumn("part", F.pmod(F.xxhash64("sig1", "sig2"), _parts(F.col("classes"))).cast("int"))
    links = _links(texts, lists, groups, split)
    found = components(links.select(F.col("cid").alias("a"), F.col("to").alias("b")))
    weights = links.groupBy("cid", "sig1", "sig2").agg(F.sum("weight").alias("weight"))

    named = classes.join(found.withColumnRenamed("node", "cid"), "cid", "left").join(weights, ["cid", "sig1", "sig2"], "left")
    n_links = F.col("class_size") - 1 + F.coalesce("weight", F.lit(0))
    named = stored(named.select(*key, "class_size", F.col("cid").alias("class_id"), F.coalesce("component", "cid").alias("component_id"), n_links.alias("n_links")))
    out = ["doc_id", "n_shingles", "class_id", "component_id", "n_links"]
    members = join_groups(full.select("doc_id", *key), named, key, "class_size").select(*out)
    none = F.lit(0).cast("long").alias("n_links")
    alone = signed.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"), none)
    return members.unionByName(alone)
