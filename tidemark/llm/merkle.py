"""Operator 13: Merkle manifest of a dataset, a tree of digests for each value of a column and one over the trees.

H is the lowercase hex SHA-256 of its inputs, concatenated, digests as hex text.  A row's leaf
is H of its fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and the value.  In a
tree the leaves ascend by the order column; every FANOUT consecutive nodes become their H,
level by level, until one is left, the subroot (a lone leaf is its own).  Subroots, ordered by
tree (null first, UTF-8 bytewise), give the root in the same way.

A block is an aligned subtree of LEVELS levels, so every block but a tree's last is full and no
task holds more than one at a time.  A block is traversed postorder by recursion: a call
returns its subtree's digest, and while it unwinds, the leaves below get the siblings of the
node that holds them.  Block roots are the leaves of the next round of blocks.  On the way down
again each node's path is its own siblings and then those of its block's root.

Places in a tree come from one range sort of the digests and the sizes of its partitions; texts
don't move.

Cases: null in any field is ``-``; a null order value comes first, equal ones are ordered by
their leaves, and rows equal in both are the same leaf at neighbouring places; a null tree is a
tree of its own; repeated rows are leaves each; an empty table gives no rows; texts of any
length are hashed where they are read; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved

FANOUT = 8
#: Levels of the tree in a block (FANOUT ** LEVELS leaves).
LEVELS = 3
_BLOCK = FANOUT**LEVELS
_DIGEST = 32


def leaf(*fields: Column | str) -> Column:
    """H of a row's fields, as 32 bytes."""
    texts = [(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def combined(digests: bytes) -> bytes:
    """H of digests, given and returned as bytes."""
    return hashlib.sha256(digests.hex().encode()).digest()


def height(n: int) -> int:
    """Levels above the leaves of a block in a tree of n leaves: LEVELS, fewer if the block is the whole tree."""
    h = 0
    while h < LEVELS and n > 1:
        n, h = -(-n // FANOUT), h + 1
    return h


def traverse(digests: list[bytes], levels: int, paths: list[list[bytes]] | None = None) -> bytes:
    """The digest of the subtree over these leaves; appends to each leaf's path its siblings at each level.

    A level of a path is the node's place in its run, the number of its siblings, and these, left to right.
    """

    def visit(first: int, end: int, level: int) -> bytes:
        if level == 0:
            return digests[first]
        step = FANOUT ** (level - 1)
        starts = range(first, end, step)
        run = b"".join([visit(x, min(x + step, end), level - 1) for x in starts])
        if paths is not None:
            for k, x in enumerate(starts):
                others = bytes((k, len(starts) - 1)) + run[: k * _DIGEST] + run[(k + 1) * _DIGEST :]
                for y in range(x, min(x + step, end)):
                    paths[y].append(others)
        return combined(run)

    return visit(0, len(digests), levels)


def fold(digest: bytes, path: bytes) -> tuple[bytes, bytes]:
    """The root that a leaf and a path lead to; and H of the path's siblings."""
    at, siblings = 0, []
    while at < len(path):
        k, n = path[at], path[at + 1]
        run = path[at + 2 : at + 2 + n * _DIGEST]
        digest = combined(run[: k * _DIGEST] + digest + run[k * _DIGEST :])
        siblings.append(run)
        at += 2 + len(run)
    return digest, combined(b"".join(siblings))


def _placed(rows: DataFrame, name: str) -> DataFrame:
    """rows (tree, id, digest, …) with their place (pos) in the tree and its size (n); no task or group holds a tree."""
    order = [F.asc_nulls_first("tree"), F.asc_nulls_first("id"), F.asc("digest"), F.asc("tie")]
    tied = saved(rows, name).withColumn("tie", F.monotonically_increasing_id())  # equal rows can be cut between partitions too
    at = saved(tied.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumn("at", F.monotonically_increasing_id()), f"{name}-sorted")
    part = F.shiftright("at", 33)
    sizes = at.groupBy("tree", part.alias("part")).agg(F.count(F.lit(1)).alias("size"), F.min("at").alias("first"))
    whole = Window.partitionBy("tree")  # rows are partitions that a tree reaches into
    before = F.sum("size").over(whole.orderBy("part")) - F.col("size")
    starts = saved(sizes.select(F.col("tree").alias("t"), F.col("part").alias("p"), (before - F.col("first")).alias("shift"), F.sum("size").over(whole).alias("n")), f"{name}-starts")
    return at.join(starts, F.col("tree").eqNullSafe(F.col("t")) & (part == F.col("p"))).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "t", "p", "shift")


def _blocks(nodes: DataFrame) -> DataFrame:
    """One row a block: tree, block, n (leaves of the tree), nodes in order."""
    payload = [c for c in nodes.columns if c not in ("tree", "n", "pos")]
    return nodes.groupBy("tree", F.expr(f"pos div {_BLOCK}").alias("block")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", *payload))).alias("nodes"))


def _roots(blocks: DataFrame) -> DataFrame:
    """The nodes of the next round: the blocks' roots."""

    def run(batches):
        for batch in batches:
            n, nodes = batch.column(2).to_pylist(), batch.column(3)
            out = [traverse(nodes[i].values.field("digest").to_pylist(), height(size)) for i, size in enumerate(n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([-(-x // _BLOCK) for x in n], pa.int64()), pa.array(out, pa.binary())], ["tree", "pos", "n", "digest"])

    kinds = {f.name: f.dataType for f in blocks.schema}
    return blocks.mapInArrow(run, T.StructType([T.StructField("tree", kinds["tree"]), T.StructField("pos", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType())]))


def _climb(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round, and the trees' last nodes."""
    rounds = []
    while True:
        rounds.append(saved(_blocks(nodes), f"{name}-blocks"))
        nodes = saved(_roots(rounds[-1]), f"{name}-roots")
        if nodes.where("n > 1").isEmpty():
            return rounds, nodes


def _descend(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Nodes with the path from each to the root; ``above`` has it (tree, pos, path, subroot, root) for the blocks' roots."""
    node = blocks.schema["nodes"].dataType.elementType
    kept = [f for f in node.fields if f.name != "pos"]
    ends = ["subroot", "root"]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                nodes, paths = batch.column(3)[i].values, None
                digests = nodes.field("digest").to_pylist()
                paths = [[] for _ in digests]
                traverse(digests, height(batch.column(2)[i].as_py()), paths)
                up = batch.column(4)[i].as_py()
                every = pa.array(np.full(len(digests), i))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(every), nodes.field("pos"), *(nodes.field(f.name) for f in kept), pa.array([b"".join(p) + up for p in paths], pa.binary()), *(batch.column(5 + j).take(every) for j in range(2))],
                    ["tree", "pos", *(f.name for f in kept), "path", *ends],
                )

    schema = T.StructType([T.StructField("tree", blocks.schema["tree"].dataType), node["pos"], *kept, T.StructField("path", T.BinaryType()), *(T.StructField(e, T.BinaryType()) for e in ends)])
    up = above.select(F.col("tree").alias("t"), F.col("pos").alias("p"), "path", *ends)
    met = blocks.join(up, F.col("tree").eqNullSafe(F.col("t")) & (F.col("block") == F.col("p")))
    return met.select("tree", "block", "n", "nodes", "path", *ends).mapInArrow(run, schema)


def manifest(docs: DataFrame, fields: list[str], tree_col: str = "lang", id_col: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """tree, id, leaf, subroot, root, path of every row, and the columns of ``keep``; digests are bytes.

    fold() leads from a leaf along its path to the root.
    """
    keep = keep or {}
    rows = docs.select(F.col(tree_col).alias("tree"), F.col(id_col).alias("id"), leaf(*fields).alias("digest"), *(c.alias(f"kept_{k}") for k, c in keep.items()))
    trees, subroots = _climb(_placed(rows, "merkle-leaves"), "merkle")
    over, root = _climb(_placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("id"), "digest"), "merkle-subroots"), "merkle-root")
    found = root.select("tree", "pos", F.lit(b"").alias("path"), F.lit(b"").alias("subroot"), F.col("digest").alias("root"))
    for blocks in reversed(over):
        found = _descend(blocks, found)
    found = found.select(F.col("id").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root")
    for blocks in reversed(trees):
        found = _descend(blocks, found)
    return found.select("tree", "id", F.col("digest").alias("leaf"), "subroot", "root", "path", *(F.col(f"kept_{k}").alias(k) for k in keep))


def verify(proofs: DataFrame, claimed_col: str) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root (from the claimed leaf and the path), verified; digests as hex text."""

    def run(batches):
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            folded = [fold(d, p) for d, p in zip(columns[claimed_col].to_pylist(), columns["path"].to_pylist(), strict=True)]
            root = columns["root"].to_pylist()
            yield pa.RecordBatch.from_arrays(
                [columns["id"], *(pa.array([d.hex() for d in columns[c].to_pylist()], pa.string()) for c in ("leaf", "subroot", "root")), pa.array([x[1].hex() for x in folded], pa.string()), pa.array([x[0].hex() for x in folded], pa.string()), pa.array([x[0] == r for x, r in zip(folded, root, strict=True)], pa.bool_())],
                ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )

    texts = [T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
    return proofs.select("id", "leaf", "subroot", "root", "path", claimed_col).mapInArrow(run, T.StructType([T.StructField("id", proofs.schema["id"].dataType), *texts, T.StructField("verified", T.BooleanType())]))
