"""Prefix trie of conversations, merged from partial tries.

A node is a sequence of turns from the beginning of a conversation. Its key is a sum,
over its turns, of a hash of the turn and of its place (128 bits), so keys of all
prefixes are running sums and a conversation may be cut anywhere: turns are sorted by
ranges, each task makes chunks of at most ``CHUNK`` turns, and a chunk needs only how
many turns, and what sum, came before it. No task holds a whole conversation.

Each task combines its chunks to a partial trie: a row for each node with its members,
smallest member and the bytes its members still have before them. Partial tries are
merged by key in a tree, first within groups of tasks, then all; members and bytes are
summed. A node that is a whole conversation keeps the list of these conversations in
sorted pieces, merged by ranges of ids and hashed in order, a piece at a time.

The rollup needs no step for each depth. The nodes whose smallest member is c are the
last ones on the path of c: such paths part the trie. Sums from the end of a path
upwards give each node what lies below it on its own path, and the path's sum goes to
all nodes above it, in one aggregation by key.

Rows without conv_id belong to no conversation and are left out. Null turns come first;
rows of one turn are ordered by role, then by the beginning of the text, then by hash.
Null roles and texts are empty. Equal rows are turns of their own. A conversation with
rows is a member of the root even if nothing of it is left. An empty table gives no
rows, not even a root.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import bound_batches, few, looked_up, parts, settled, table, written
from ._words import mix

FAMILY = 5
HEADS = 9  #: the first 0 to 8 turns come from the family's first conversation
CHUNK = 4096
#: Ids in a piece of a list, and characters of a text that order rows of one turn.
PIECE = 1 << 10
TIE = 32
#: Groups in which partial tries meet before all do.
FAN = 16
#: Nodes of a partial trie that a task combines at once.
NODES = 1 << 17

_CHUNKS = "conv_id bigint, fam bigint, part int, seq bigint, n int, h1 binary, h2 binary, nb binary"
_PATHS = "conv_id bigint, part int, seq bigint, start bigint, n int, begins boolean, last boolean, s1 bigint, s2 bigint, bytes bigint, k1 binary, k2 binary, nb binary"
_NODES = "k1 bigint, k2 bigint, p1 bigint, p2 bigint, depth bigint, nb bigint, conv_id bigint, n bigint, ahead bigint"
_U = np.uint64


def heads_of(ids: np.ndarray) -> np.ndarray:
    """How many turns each conversation takes from the first of its family."""
    return np.fromiter((zlib.crc32(b"%d" % c) % HEADS for c in ids.tolist()), np.int64, len(ids))


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}


def _kind(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _table(ddl: str, columns: list) -> pa.RecordBatch:
    kind = _kind(ddl)
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)


def _pieces(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _turns(rows: DataFrame) -> DataFrame:
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    fam = F.col("conv_id") - F.col("conv_id") % FAMILY
    rows = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint"), "turn", role.alias("role"), text.alias("text"))
    return rows.select(
        "conv_id", fam.alias("fam"), "turn", "role", F.substring("text", 1, TIE).alias("tie"), F.xxhash64(F.lit(1), "role", "text").alias("h1"), F.xxhash64(F.lit(2), "role", "text").alias("h2"), F.octet_length("text").alias("nb")
    )


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of the conversations of a sorted partition; a conversation at the end of a batch waits for the next."""
    part, seq = TaskContext.get().partitionId(), 0
    rest: pa.Table | None = None

    def cut(t: pa.Table, all_of_it: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
        nonlocal seq
        conv = t["conv_id"].to_numpy()
        at = np.concatenate([[0], np.flatnonzero(conv[1:] != conv[:-1]) + 1, [len(conv)]])
        at = np.unique(np.concatenate([np.arange(a, b, CHUNK) for a, b in zip(at[:-1], at[1:], strict=True)] + [at[-1:]]))
        if not all_of_it and len(at) and len(conv) - at[-2] < CHUNK:
            at = at[:-1]
        if len(at) < 2:
            return None, t
        one = lambda name, kind: (lambda v: [v[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])(t[name].to_numpy().astype(kind))
        m = len(at) - 1
        out = _table(_CHUNKS, [conv[at[:-1]], t["fam"].to_numpy()[at[:-1]], np.full(m, part), np.arange(seq, seq + m), np.diff(at), _pieces(one("h1", "<i8")), _pieces(one("h2", "<i8")), _pieces(one("nb", "<i4"))])
        seq += m
        return out, t.slice(int(at[-1]))

    for batch in batches:
        now = pa.Table.from_batches([batch]).select(["conv_id", "fam", "h1", "h2", "nb"])
        rest = pa.concat_tables([rest, now]) if rest is not None else now
        if rest.num_rows:
            out, rest = cut(rest, False)
            if out is not None:
                yield out
    if rest is not None and rest.num_rows:
        out, _ = cut(rest, True)
        if out is not None:
            yield out


def _several(chunks: DataFrame) -> DataFrame:
    """Conversations of several chunks and how many: giants, and those at the ends of partitions."""
    return chunks.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1")


def _with_offsets(chunks: DataFrame, several: DataFrame) -> DataFrame:
    """Chunks with how many turns of their conversation come before, and whether any come after. Conversations of one chunk need no window."""
    meta = chunks.select("conv_id", "part", "seq", "n").join(few(several.select("conv_id")), "conv_id")
    w = Window.partitionBy("conv_id").orderBy("part", "seq")
    before = meta.select("part", "seq", (F.sum("n").over(w) - F.col("n")).alias("_before"), F.lead("n").over(w).isNull().alias("_last"))
    joined = chunks.join(few(before, 4), ["part", "seq"], "left")
    return joined.select(*chunks.columns, F.coalesce("_before", F.lit(0)).cast("bigint").alias("before"), F.coalesce("_last", F.lit(True)).alias("last"))


def _with_heads(chunks: DataFrame) -> DataFrame:
    """Chunks with the first turns of their family's first conversation (null: none)."""
    starts = chunks.where(f"conv_id = fam AND before < {HEADS - 1}")
    short = lambda c, size: F.substring(c, 1, size * (HEADS - 1)).alias(c)
    heads = starts.groupBy("fam").agg(F.sort_array(F.collect_list(F.struct("before", short("h1", 8), short("h2", 8), short("nb", 4)))).alias("_heads"))
    sizes = written(chunks.groupBy("fam").agg(F.count(F.lit(1)).alias("_rows")).join(heads, "fam", "left"), "heads")
    return looked_up(chunks, sizes, "fam", "_rows", 3 * HEADS)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rebuilt turns of each chunk: sums of keys from the chunk's beginning on, and bytes."""
    for batch in batches:
        conv, before = batch["conv_id"].to_numpy(), batch["before"].to_numpy()
        h = heads_of(conv)
        rows = []
        for i, r in enumerate(batch.select(["h1", "h2", "nb", "_heads", "fam", "last", "part", "seq"]).to_pylist()):
            own = [np.frombuffer(r[c], kind) for c, kind in (("h1", "<i8"), ("h2", "<i8"), ("nb", "<i4"))]
            heads = [np.frombuffer(b"".join(x[c] for x in r["_heads"] or []), kind)[: h[i]] for c, kind in (("h1", "<i8"), ("h2", "<i8"), ("nb", "<i4"))]
            skip = max(0, int(h[i] - before[i]))  # own turns that the family's first conversation stands for
            taken = len(heads[0])
            if before[i] == 0:
                start, turns = 0, [np.concatenate([a, b[skip:]]) for a, b in zip(heads, own, strict=True)]
            else:
                start, turns = taken + max(0, int(before[i] - h[i])), [b[skip:] for b in own]
            n = len(turns[0])
            place = mix(np.arange(start + 1, start + n + 1).astype(_U))
            k1, k2 = (np.cumsum(mix(turns[j].astype(np.int64).view(_U) ^ (place + _U(j))), dtype=_U).view(np.int64) for j in (0, 1))
            rows.append((int(conv[i]), r["part"], r["seq"], start, n, bool(before[i] == 0), r["last"], int(k1[-1]) if n else 0, int(k2[-1]) if n else 0, int(turns[2].sum()), k1.astype("<i8").tobytes(), k2.astype("<i8").tobytes(), turns[2].astype("<i4").tobytes()))
        yield _table(_PATHS, list(zip(*rows, strict=True)) if rows else [[]] * 13)


def _with_carries(paths: DataFrame, several: DataFrame) -> DataFrame:
    """Chunks with the key before them (c1, c2: the sums of the chunks before) and the bytes that come after them."""
    meta = paths.select("conv_id", "part", "seq", "s1", "s2", "bytes").join(few(several.select("conv_id")), "conv_id")
    before = Window.partitionBy("conv_id").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("conv_id").orderBy("part", "seq").rowsBetween(1, Window.unboundedFollowing)

    def carry(c: str) -> Column:  # sums of 64-bit numbers wrap around
        around, half = F.lit(str(2**64)).cast("decimal(38,0)"), F.lit(str(2**63)).cast("decimal(38,0)")
        x = F.pmod(F.coalesce(F.sum(F.col(c).cast("decimal(20,0)")).over(before), F.lit(0)).cast("decimal(38,0)"), around)
        return F.when(x >= half, x - around).otherwise(x).cast("bigint")

    found = meta.select("part", "seq", carry("s1").alias("c1"), carry("s2").alias("c2"), F.coalesce(F.sum("bytes").over(after), F.lit(0)).alias("after"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return paths.join(few(found, 5), ["part", "seq"], "left").select(*paths.columns, zero("c1"), zero("c2"), zero("after"))


def _flat(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The nodes of each chunk of a batch, the root before the first turn included: chunk, depth, key, parent's key, bytes from the node on."""
    n, start = batch["n"].to_numpy().astype(np.int64), batch["start"].to_numpy()
    root = batch["begins"].to_numpy(zero_copy_only=False).astype(np.int64)
    size = n + root
    chunk = np.repeat(np.arange(len(n)), size)
    ends = np.cumsum(size)
    place = np.arange(len(chunk)) - np.repeat(ends - size, size) - root[chunk]  # -1: the root
    at = np.concatenate([[0], np.cumsum(n)])[:-1][chunk] + place
    inner = place >= 0
    get = lambda name, kind: np.frombuffer(b"".join(batch[name].to_pylist()), kind)
    nb = get("nb", "<i4").astype(np.int64)
    out = {"chunk": chunk, "depth": start[chunk] + place + 1, "nb": np.zeros(len(chunk), np.int64)}
    out["nb"][inner] = nb[at[inner]]
    for k, p, c in (("k1", "p1", "c1"), ("k2", "p2", "c2")):
        sums, carry = get(k, "<i8"), batch[c].to_numpy()
        key, parent = np.zeros(len(chunk), np.int64), np.zeros(len(chunk), np.int64)
        with np.errstate(over="ignore"):
            key[inner] = sums[at[inner]] + carry[chunk[inner]]
            later = place > 0
            parent[later] = sums[at[later] - 1] + carry[chunk[later]]
            parent[place == 0] = carry[chunk[place == 0]]
        out[k], out[p] = key, parent
    total = np.concatenate([[0], np.cumsum(out["nb"])])  # bytes from the node on: those up to the chunk's end and those after it
    out["ahead"] = total[ends[chunk]] - total[:-1] + batch["after"].to_numpy()[chunk]
    return out


def _combined(keys: list[np.ndarray], least: np.ndarray, sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Rows that stand first for each key, the least of ``least`` and the sums of ``sums`` over the key's rows."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    at = np.flatnonzero(new)
    return order[at], np.minimum.reduceat(least[order], at), [np.add.reduceat(s[order], at) for s in sums]


def _gathered(batches: Iterator[pa.RecordBatch], turns: str) -> Iterator[pa.RecordBatch]:
    """Batches cut so that they hold about ``NODES`` nodes."""
    for batch in batches:
        total = np.cumsum(batch[turns].to_numpy().astype(np.int64) + 1)
        cuts = np.unique(np.concatenate([[0], np.searchsorted(total, np.arange(NODES, total[-1] if len(total) else 0, NODES)) + 1, [batch.num_rows]]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(int(a), int(b - a))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partial trie: nodes of a batch of paths, each once."""
    for batch in _gathered(batches, "n"):
        x = _flat(batch)
        if len(x["chunk"]):
            first, least, (n, ahead) = _combined([x["k1"], x["k2"]], batch["conv_id"].to_numpy()[x["chunk"]], [np.ones(len(x["chunk"]), np.int64), x["ahead"]])
            yield _table(_NODES, [*(x[c][first] for c in ("k1", "k2", "p1", "p2", "depth", "nb")), least, n, ahead])


def _upwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the paths of a batch give their nodes: bytes of the path's own nodes from there on, and its leaf."""
    for batch in _gathered(batches, "n"):
        x = _flat(batch)
        if not len(x["chunk"]):
            continue
        first, ahead = batch["first_own"].to_numpy()[x["chunk"]], batch["ahead_own"].to_numpy()[x["chunk"]]
        below = np.where(x["depth"] < first, ahead, x["ahead"])
        leaf = batch["leaf"].to_numpy()[x["chunk"]]
        one, _, (own, leaves) = _combined([x["k1"], x["k2"]], below, [below, leaf])
        yield _table("k1 bigint, k2 bigint, own bigint, leaves bigint", [x["k1"][one], x["k2"][one], own, leaves])


def _merged(partial: DataFrame, keys: list[str], sums: list[Column], more: list[Column]) -> DataFrame:
    """Rows of partial tries merged by key, within ``FAN`` groups of tasks and then all."""
    near = partial.groupBy(*keys, F.pmod(F.spark_partition_id(), F.lit(FAN)).alias("_group")).agg(*sums, *more)
    return near.groupBy(*keys).agg(*sums, *more)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of each key of a sorted partition, as text in pieces."""
    for batch in batches:
        k1, k2, conv = (batch[c].to_numpy() for c in ("k1", "k2", "conv_id"))
        new = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
        at = np.concatenate([[0], new, [len(k1)]]) if len(k1) else np.zeros(1, np.int64)
        at = np.unique(np.concatenate([np.arange(a, b, PIECE) for a, b in zip(at[:-1], at[1:], strict=True)] + [at[-1:]]))
        text = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield _table("k1 bigint, k2 bigint, first bigint, ids string", [k1[at[:-1]], k2[at[:-1]], conv[at[:-1]], text])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each key's pieces, in order; a partition is sorted, and only a hash is carried on."""
    now, digest = None, hashlib.sha256()
    for batch in batches:
        done = []
        for k1, k2, ids in zip(batch["k1"].to_pylist(), batch["k2"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            if (k1, k2) == now:
                digest.update(b",")
            else:
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = (k1, k2), hashlib.sha256()
            digest.update(ids.encode())
        yield _table("k1 bigint, k2 bigint, ends_sha256 string", list(zip(*done, strict=True)) if done else [[]] * 3)
    if now is not None:
        yield _table("k1 bigint, k2 bigint, ends_sha256 string", [[x] for x in (*now, digest.hexdigest())])


def _last_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        with np.errstate(over="ignore"):
            keys = [batch[s].to_numpy() + batch[c].to_numpy() for s, c in (("s1", "c1"), ("s2", "c2"))]
        yield _table("k1 bigint, k2 bigint, conv_id bigint", [*keys, batch["conv_id"]])


def ends(paths: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 of the nodes at which conversations end."""
    each = paths.where("last").select("conv_id", "s1", "s2", "c1", "c2").mapInArrow(_last_keys, "k1 bigint, k2 bigint, conv_id bigint")
    n = parts(each)
    pieces = each.repartitionByRange(n, "k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id").mapInArrow(_listed, "k1 bigint, k2 bigint, first bigint, ids string")
    return pieces.repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_hashed, "k1 bigint, k2 bigint, ends_sha256 string")


def paths_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations as chunks with their keys, written; conversations of several chunks."""
    turns = written(_turns(conversations), "turns")  # texts are read once; what is sorted is small
    order = ["fam", "conv_id", F.col("turn").asc_nulls_first(), "role", "tie", "h1", "h2"]
    ranged = turns.repartitionByRange(parts(turns), *order).sortWithinPartitions(*order)
    chunks = written(ranged.mapInArrow(_chunked, _CHUNKS), "chunks")
    several = written(_several(chunks), "several")
    placed = written(_with_heads(_with_offsets(chunks, several)).mapInArrow(_paths, _PATHS), "placed")
    return written(_with_carries(placed, several), "paths"), several


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the rebuilt ``conversations`` (conv_id, turn, role, text)."""
    bound_batches(conversations.sparkSession)
    paths, several = paths_of(conversations)
    key = ["k1", "k2"]
    sums = lambda *names: [F.sum(c).alias(c) for c in names]
    nodes = written(_merged(paths.mapInArrow(_partial, _NODES), key, sums("n", "ahead"), [F.min("conv_id").alias("conv_id"), *(F.first(c).alias(c) for c in ("p1", "p2", "depth", "nb"))]), "merged")
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))), "nodes")
    # each conversation owns the nodes of its path from some depth on
    own = nodes.groupBy("conv_id").agg(F.min("depth").alias("first_own"), F.sum("nb").alias("ahead_own"), F.max((F.col("n_children") == 0).cast("bigint")).alias("leaf"))
    own = written(own.join(few(several), "conv_id", "left").withColumn("_m", F.coalesce("_m", F.lit(1))), "own")
    upward = looked_up(paths, own, "conv_id", "_m", 4).where("first_own IS NOT NULL")
    rolled = _merged(upward.mapInArrow(_upwards, "k1 bigint, k2 bigint, own bigint, leaves bigint"), key, sums("own", "leaves"), [])
    named = nodes.join(rolled, key).join(ends(paths), key, "left").withColumn("_parent", F.struct(F.col("p1").alias("k1"), F.col("p2").alias("k2")))
    parents = nodes.where("n_children > 0 OR depth = 0").select(F.struct("k1", "k2").alias("_parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_rows"))
    return looked_up(named, parents, "_parent", "_rows", 3).select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        "n_children",
        F.col("leaves").alias("n_leaves"),
        (F.col("ahead") - F.col("own")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def op12_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each node of the trie of all ``conversations``; the root has no parent. See the module for nulls, ties, repeated rows and empty tables."""
    return settled(lambda: trie(table(spark, sf_dir, "conversations")), "trie")


#: Checksums bit by bit; a node is the list of its turns.
ORACLE = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda b: CAST(ord(b) AS UBIGINT))),
    lambda x, b: list_reduce(list_prepend(xor(x, b), list_transform(range(8), lambda k: CAST(0 AS UBIGINT))), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y >> 1, CAST(3988292384 AS UBIGINT)) ELSE y >> 1 END)), CAST(4294967295 AS UBIGINT)) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.i <= c.h UNION ALL SELECT c.conv_id, 1, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
q AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY own, i) AS path FROM r GROUP BY conv_id),
f AS (SELECT c.conv_id, coalesce(q.path, []) AS path FROM c LEFT JOIN q USING (conv_id)),
m AS (SELECT conv_id, path[1:d] AS node, d, len(path) = d AS ended, CASE WHEN d > 0 THEN strlen(path[d].text) ELSE 0 END AS size FROM (SELECT conv_id, path, unnest(range(len(path) + 1)) AS d FROM f)),
n AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ended), '') AS ends FROM m GROUP BY node, d),
k AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM n x WHERE x.d = n.d + 1 AND x.node[1:n.d] = n.node) AS n_children FROM n LEFT JOIN n p ON p.d = n.d - 1 AND p.node = n.node[1:n.d - 1])
SELECT conv_id, CAST(d AS BIGINT) AS depth, parent_conv_id, n_convs, n_children,
  (SELECT count(*) FROM k x WHERE x.n_children = 0 AND x.d >= k.d AND x.node[1:k.d] = k.node) AS n_leaves,
  CAST((SELECT sum((x.n_convs - 1) * x.size) FROM k x WHERE x.d >= k.d AND x.node[1:k.d] = k.node) AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256 FROM k
"""
