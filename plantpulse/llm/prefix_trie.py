"""The trie of conversation prefixes, with subtree totals rolled up band by band.

A node is a distinct sequence of first turns (role, text). It is named by its depth and two polynomial hashes of its turns modulo the
prime 2**61 - 1 (the turns themselves by MD5), about 122 bits in all. Such hashes of two stretches combine, so turns are hashed in parts
of equal size whatever the length of a conversation, and a carry per part makes them whole; the hash of a node's parent follows from
that of its last turn.

Subtree totals: the depths are cut into bands of ``height`` levels. Each node adds itself to its ancestors in its band, found along the
path of its smallest member, at most ``height`` of them. What the topmost node of a band has then is a node of a tree of bands, which is
summed in the same way, bands of bands and so on, until one band is left. The completed totals of the topmost nodes go to their
ancestors in the band above. A tree of depth D takes about 2 * log(D) / log(height) rounds.

Defined results: rows without conv_id belong to no conversation and are left out. Turns go by number, null first; equal numbers go by the
MD5 of role and text, repeated rows are repeated turns. A null role or text counts as empty. The root is a node wherever there is a
conversation; an empty table has no nodes. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, stored

PRIME = (1 << 61) - 1
#: fixed bases of the two hashes
BASES = (1_148_021_573_907_641_321, 1_993_250_734_112_896_077)
INVERSES = tuple(pow(b, -1, PRIME) for b in BASES)
#: levels of a band
HEIGHT = 16
#: conversation ids that are joined to one piece of text
IDS_AT_ONCE = 4096

NODE = ["depth", "p1", "p2"]
_TURN = "conv_id long, at long, p1 long, p2 long, t1 long, t2 long, n_bytes long"
_PATH = "conv_id long, depth long, p1 long, p2 long, q1 long, q2 long, t1 long, t2 long, n_bytes long, is_end boolean"


def _turn_hash() -> tuple[Column, Column]:
    """Two numbers of 60 bits from the MD5 of role and text."""
    digest = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.conv(F.substring(digest, 17, 15), 16, 10).cast("long")


def hashed_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, t1, t2 and n_bytes of each row of a conversation."""
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
                                                              F.coalesce("text", F.lit("")).alias("text"))
    t1, t2 = _turn_hash()
    return rows.withColumns({"t1": t1, "t2": t2, "n_bytes": F.octet_length("text").cast("long")})


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """One stored row per turn: its place ``at`` (from 0) in its conversation and the hashes of the prefix that ends with it."""
    order = ["conv_id", "turn", "t1", "t2"]
    rows = hashed_rows(conversations).select(*order, "n_bytes").repartitionByRange(*order).sortWithinPartitions(*order)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at, p1, p2 = TaskContext.get().partitionId(), None, 0, 0, 0
        for batch in batches:
            out = []
            for conv, t1, t2 in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "t1", "t2"))):
                if conv != last:
                    last, at, p1, p2 = conv, 0, 0, 0
                p1, p2 = (p1 * BASES[0] + t1) % PRIME, (p2 * BASES[1] + t2) % PRIME
                out.append((at, p1, p2))
                at += 1
            added = [pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), ()))]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *added, *map(batch.column, ("t1", "t2", "n_bytes")), pa.array([part] * len(out), pa.int32())],
                                             ["conv_id", "at", "p1", "p2", "t1", "t2", "n_bytes", "part"])

    local = stored(rows.mapInArrow(scan, f"{_TURN}, part int"))
    carries = _carries(local)
    turns = local.drop("part")
    names = turns.columns
    if not carries:
        return turns

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, p1, p2 = (batch.column(c).to_pylist() for c in ("at", "p1", "p2"))
            for i, key in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("part").to_pylist())):
                if key in carries:
                    before, c1, c2 = carries[key]
                    p1[i], p2[i] = _joined((c1, c2), (p1[i], p2[i]), at[i] + 1)
                    at[i] += before
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, pa.int64()) for c in (at, p1, p2)), *map(batch.column, ("t1", "t2", "n_bytes"))], names)

    return stored(local.mapInArrow(carried, _TURN))


def _joined(before: tuple[int, int], after: tuple[int, int], length: int) -> tuple[int, ...]:
    """The hashes of a stretch and, behind it, another one of ``length`` turns."""
    return tuple((a * pow(b, length, PRIME) + c) % PRIME for a, b, c in zip(before, BASES, after))


def _carries(local: DataFrame) -> dict[tuple[int, int], tuple[int, int, int]]:
    """Turns and hashes before a part, for conversations that lie in several: at most one per border of the parts."""
    runs = local.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.max_by(F.struct("p1", "p2"), "at").alias("p"))
    several = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "n", "p"))).alias("runs")).filter("size(runs) > 1")
    carries = {}
    for row in several.toLocalIterator():
        before, hashes = 0, (0, 0)
        for run in row["runs"]:
            if before:
                carries[row["conv_id"], run["part"]] = (before, *hashes)
            hashes = _joined(hashes, tuple(run["p"]), run["n"])
            before += run["n"]
    return carries


def plain_paths(turns: DataFrame) -> DataFrame:
    """The nodes along each conversation as it is."""
    size = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    facts = stored(size.withColumns({name: F.lit(0).cast("long") for name in ("skip", "lead", "d1", "d2")}).withColumn("length", F.col("n")))
    return stored(_roots(facts).unionByName(_own_part(turns, facts)))


def rebuilt_paths(turns: DataFrame, family: int = 5, spread: int = 9) -> DataFrame:
    """The nodes along each conversation c whose first h turns are those of conversation c - c % ``family``; h is the CRC-32 of c modulo ``spread``.

    Only the first ``spread`` - 1 turns of a conversation are gathered; the hashes behind them are moved by the difference of two heads.
    """
    longest = spread - 1
    head = F.collect_list(F.when(F.col("at") < longest, F.struct("at", "p1", "p2", "t1", "t2", "n_bytes")))
    convs = stored(turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.sort_array(head).alias("head")))
    lending = convs.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("lender"), F.col("head").alias("lent"))
    both = (convs.withColumn("lender", F.col("conv_id") - F.col("conv_id") % family).join(lending, "lender", "left")
            .withColumn("skip", F.crc32(F.col("conv_id").cast("string").cast("binary")) % spread)
            .withColumn("lead", F.least("skip", F.coalesce(F.size("lent"), F.lit(0)).cast("long")))
            .withColumn("lead", F.greatest("lead", F.lit(0).cast("long"))))

    def at_end(heads: str, count: str, name: str) -> Column:
        return F.coalesce(F.when(F.col(count) > 0, F.get(heads, (F.col(count) - 1).cast("int"))[name]), F.lit(0).cast("long"))

    moved = {f"d{k}": F.pmod(at_end("lent", "lead", f"p{k}") - at_end("head", "skip", f"p{k}"), F.lit(PRIME)) for k in (1, 2)}
    facts = stored(both.withColumns(moved | {"length": F.col("lead") + F.greatest(F.col("n") - F.col("skip"), F.lit(0).cast("long"))})
                   .withColumn("lent", F.slice(F.coalesce("lent", F.array().cast(convs.schema["head"].dataType)), F.lit(1), F.col("lead").cast("int"))).drop("head", "lender"))
    lent = facts.filter("lead > 0").select("conv_id", "length", "lent", F.posexplode("lent").alias("i", "turn"))
    before = F.get("lent", F.col("i") - 1)
    lent = lent.select("conv_id", (F.col("i") + 1).cast("long").alias("depth"), "turn.p1", "turn.p2", *[F.coalesce(before[f"p{k}"], F.lit(0).cast("long")).alias(f"q{k}") for k in (1, 2)],
                       "turn.t1", "turn.t2", "turn.n_bytes", (F.col("i") + 1 == F.col("length")).alias("is_end"))
    return stored(_roots(facts).unionByName(lent).unionByName(_own_part(turns, facts.drop("lent"))))


def _roots(facts: DataFrame) -> DataFrame:
    nothing = F.lit(0).cast("long")
    return facts.select("conv_id", *[nothing.alias(c) for c in ("depth", "p1", "p2", "q1", "q2", "t1", "t2", "n_bytes")], (F.col("length") == 0).alias("is_end"))


def _own_part(turns: DataFrame, facts: DataFrame) -> DataFrame:
    """The path behind the first ``skip`` turns, which stand behind ``lead`` others; d1 and d2 are the differences of the two heads' hashes."""
    rows = join_groups(turns, facts, ["conv_id"], "n").filter(F.col("at") >= F.col("skip"))

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ("at", "skip", "lead", "length", "p1", "p2", "d1", "d2", "t1", "t2")
            out = []
            for at, skip, lead, length, p1, p2, d1, d2, t1, t2 in zip(*(batch.column(c).to_pylist() for c in names)):
                if d1 or d2:
                    p1, p2 = _joined((d1, d2), (p1, p2), at + 1 - skip)
                out.append((lead + at - skip + 1, p1, p2, (p1 - t1) * INVERSES[0] % PRIME, (p2 - t2) * INVERSES[1] % PRIME, lead + at - skip + 1 == length))
            *numbers, is_end = zip(*out) if out else ((),) * 6
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, pa.int64()) for c in numbers), *map(batch.column, ("t1", "t2", "n_bytes")), pa.array(is_end, pa.bool_())],
                                             ["conv_id", "depth", "p1", "p2", "q1", "q2", "t1", "t2", "n_bytes", "is_end"])

    return rows.mapInArrow(move, _PATH)


def subtree_totals(nodes: DataFrame, paths: DataFrame, values: list[str], height: int = HEIGHT) -> DataFrame:
    """depth, p1, p2, conv_id and the sums of ``values`` over the subtree of each node.

    ``nodes`` has one row per node with its smallest member conv_id; ``paths`` the nodes along each conversation.
    """
    deepest = nodes.agg(F.max("depth")).first()[0]
    return _totals(nodes.select(*NODE, "conv_id", *values), paths.select("conv_id", *NODE), values, height, deepest or 0)


def _lifted(nodes: DataFrame, band: Column, above: DataFrame, values: list[str], height: int, same_band: bool) -> DataFrame:
    """The rows of ``nodes`` at their ancestors among ``above`` in the given band, with themselves where the band is their own."""
    here = nodes.select("conv_id", band.alias("band"), F.col("depth").alias("from_depth"), *values)
    there = above.select("conv_id", F.floor(F.col("depth") / height).alias("band"), *NODE)
    joined = here.join(there, ["conv_id", "band"])
    return joined.filter("depth <= from_depth") if same_band else joined


def _totals(nodes: DataFrame, paths: DataFrame, values: list[str], height: int, deepest: int) -> DataFrame:
    sums = [F.min("conv_id").alias("conv_id"), *[F.sum(v).alias(v) for v in values]]
    band = F.floor(F.col("depth") / height)
    within = stored(_lifted(nodes, band, paths, values, height, True).groupBy(*NODE).agg(*sums))
    if deepest < height:
        return within
    top = F.col("depth") % height == 0
    fold = F.floor(F.col("depth") / height).cast("long").alias("depth")
    done = _totals(within.filter(top).select(fold, "p1", "p2", "conv_id", *values), paths.filter(top).select("conv_id", fold, "p1", "p2"), values, height, deepest // height)
    below = _lifted(done.filter("depth > 0"), F.col("depth") - 1, paths.filter(~top), values, height, False)
    inner = within.filter(~top).unionByName(below.select(*within.columns)).groupBy(*NODE).agg(*sums)
    return stored(inner.unionByName(done.withColumn("depth", F.col("depth") * height)))


def ends_digests(paths: DataFrame) -> DataFrame:
    """depth, p1, p2 and the SHA-256 of the ids, ascending and joined by commas, of the conversations that end at a node.

    The ids are sorted and joined to pieces in parts of equal size; only the pieces of a node go through one task, as a stream.
    """
    order = [*NODE, "conv_id"]
    ends = paths.filter("is_end").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        for batch in batches:
            out = []
            for *node, conv in zip(*(batch.column(c).to_pylist() for c in order)):
                if node != key or len(ids) >= IDS_AT_ONCE:
                    out += [(*key, ids[0], ",".join(map(str, ids)))] if ids else []
                    key, ids = node, []
                ids.append(conv)
            yield _pieces(out)
        yield _pieces([(*key, ids[0], ",".join(map(str, ids)))] if ids else [])

    joined = ends.mapInArrow(pieces, "depth long, p1 long, p2 long, first long, ids string")
    joined = joined.repartition(*NODE).sortWithinPartitions(*NODE, "first")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
                if node != key:
                    out += [(*key, state.hexdigest())] if key else []
                    key, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            yield _digests(out)
        yield _digests([(*key, state.hexdigest())] if key else [])

    return joined.mapInArrow(digests, "depth long, p1 long, p2 long, ends_sha256 string")


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [()] * len(names), kinds)], names)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    return _table(rows, [*NODE, "first", "ids"], [pa.int64()] * 4 + [pa.string()])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return _table(rows, [*NODE, "ends_sha256"], [pa.int64()] * 3 + [pa.string()])


def trie(paths: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per node: its name (depth, p1, p2), its last turn (t1, t2, n_bytes), conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    named = [F.min(c).alias(c) for c in ("conv_id", "q1", "q2", "t1", "t2", "n_bytes")]
    nodes = stored(paths.groupBy(*NODE).agg(F.count("*").alias("n_convs"), *named))
    up = [(F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")]
    children = nodes.filter("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"))
    tree = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    tree = stored(tree.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_bytes")}))
    totals = subtree_totals(tree, paths, ["n_leaves", "saved_tokens"], height)

    parents = tree.filter("n_children > 0").select(F.col("depth").alias("q0"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"),
                                                   F.col("n_children").alias("siblings"))
    rest = [*NODE, "q0", "q1", "q2", "t1", "t2", "n_bytes", "conv_id", "n_convs", "n_children"]
    below = join_groups(tree.filter("depth > 0").withColumn("q0", F.col("depth") - 1).select(*rest), parents, ["q0", "q1", "q2"], "siblings")
    out = [*NODE, "t1", "t2", "n_bytes", "conv_id", "parent_conv_id", "n_convs", "n_children"]
    linked = below.select(*out).unionByName(tree.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*out))
    return (linked.join(totals.drop("conv_id"), NODE).join(ends_digests(paths), NODE, "left")
            .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))))


def with_last_turn(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``nodes`` with the role and text of their last turn; null for the root."""
    turns = hashed_rows(conversations).groupBy("t1", "t2").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    return nodes.join(turns, ["t1", "t2"], "left")


def prefix_trie(conversations: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The trie of the conversations as they are."""
    return trie(plain_paths(numbered_turns(conversations)), height)


def rebuilt_prefix_trie(conversations: DataFrame, family: int = 5, spread: int = 9, height: int = HEIGHT) -> DataFrame:
    """The trie of the rebuilt conversations, see ``rebuilt_paths``."""
    return trie(rebuilt_paths(numbered_turns(conversations), family, spread), height)


SQL = """
WITH t AS (
  SELECT conv_id, k, strlen(text) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) - 1 AS i FROM (
    SELECT conv_id, turn, text, md5(strlen(role)::VARCHAR || ':' || role || text) AS k FROM (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL))),
v AS (
  SELECT c, xor(4294967295, list_reduce([ascii(x)::BIGINT FOR x IN string_split(c::VARCHAR, '')], lambda s, x:
    list_reduce(range(8), lambda y, k: xor(y >> 1, 3988292384 * (y & 1)), xor(s, x)), 4294967295::BIGINT)) % 9 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM t)),
r AS (
  SELECT v.c, t.i, t.k, t.b FROM v JOIN t ON t.conv_id = v.c - v.c % 5 AND t.i < v.h UNION ALL
  SELECT v.c, t.i, t.k, t.b FROM v JOIN t ON t.conv_id = v.c AND t.i >= v.h),
path AS MATERIALIZED (
  SELECT c, d, b, md5(string_agg(k, '') OVER (PARTITION BY c ORDER BY d)) AS id FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY i) AS d FROM r)
  UNION ALL SELECT c, 0, 0, '' FROM v),
node AS MATERIALIZED (SELECT id, d, min(c) AS conv_id, count(*) AS n_convs, max(b) AS b FROM path GROUP BY id, d),
up AS (SELECT node.id, parent.id AS parent_id, parent.conv_id AS parent_conv_id FROM node JOIN path ON path.c = node.conv_id AND path.d = node.d - 1
       JOIN node parent ON parent.id = path.id),
kids AS (SELECT parent_id AS id, count(*) AS n_children FROM up GROUP BY parent_id),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (id)),
below AS (SELECT path.id, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((n_convs - 1) * n.b)::BIGINT AS saved_tokens
          FROM full_node n JOIN path ON path.c = n.conv_id AND path.d <= n.d GROUP BY path.id),
ends AS (SELECT id, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM (SELECT *, max(d) OVER (PARTITION BY c) AS last FROM path) WHERE d = last GROUP BY id)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM full_node n JOIN below USING (id) LEFT JOIN up USING (id) LEFT JOIN ends USING (id)
"""

