"""Merkle manifest of a table: leaves, roots, proofs and the check of every row, a superblock at a time.

Leaves are digests of whole rows.  Within each tree (a language) they ascend by id; while several nodes remain, each
two consecutive ones become the digest of both, a last single one the digest of itself.  Roots of trees, in order of
their names, are the leaves of one more tree, whose root stands for the table.

A tree is cut into superblocks of 2**LEVELS leaves.  Going up, each superblock is reduced to its top node in one
group; tops are again leaves of superblocks, so the number of rounds is the logarithm of the table to the base of
2**LEVELS.  Going down, each superblock needs only its *outer* nodes: the siblings from its top to the root.  They are
found superblock by superblock of the round above, and in the end leaves and outer nodes are cogrouped by superblock:
one pass reduces the leaves, joins inner and outer siblings to proofs and folds every (possibly altered) leaf with
them to a root.  A group has 2**LEVELS rows at most, however many rows a language has, and nothing is collected.

Defined cases.  A null field is ``-``; any other is its UTF-8 length, ``:`` and its value.  A null tree name comes
first, then names in the order of their bytes.  A null id comes first; rows with equal ids are ordered by leaf, so
equal rows are interchangeable.  A tree of one leaf is that leaf; one tree makes its root the root of the table.  An
empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm import support

LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ALONE, LEFT, RIGHT = b"\0", b"\1", b"\2"  # where a sibling stands; ALONE: the node had none

NODE = "tree string, block long, place long, n long, node binary"
ROW = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
       "verified boolean")


def row_digest(fields: list[Column]) -> Column:
    """Lowercase hex digest of tagged fields."""
    def tagged(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*[tagged(f) for f in fields]), 256)


# --- one superblock --------------------------------------------------------------------------------

def parents(nodes: list[bytes]) -> list[bytes]:
    """The next level: digests of the hex text of two consecutive nodes, a single last node alone."""
    return [sha256(b"".join(nodes[i:i + 2])).hexdigest().encode() for i in range(0, len(nodes), 2)]


def reduce_block(nodes: list[bytes], whole: int, levels: int) -> list[list[bytes]]:
    """All levels of a superblock from its leaves to its top.

    A superblock that is a whole tree (``whole`` nodes) ends when one node is left; part of a larger
    tree it goes up ``levels`` levels.
    """
    rows = [nodes]
    for _ in range(levels):
        if whole <= 1 << levels and len(rows[-1]) == 1:
            break
        rows.append(parents(rows[-1]))
    return rows


def inner_path(rows: list[list[bytes]], place: int) -> bytes:
    """Siblings from a leaf to the top of its superblock: where each stands, then its hex text."""
    path = []
    for level in rows[:-1]:
        other = place ^ 1
        if other >= len(level):
            path.append(ALONE)
        else:
            path.append((LEFT if other < place else RIGHT) + level[other])
        place >>= 1
    return b"".join(path)


def steps(path: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at < len(path):
        side = path[at:at + 1]
        size = 0 if side == ALONE else 64
        yield side, path[at + 1:at + 1 + size]
        at += 1 + size


def fold(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a node and its siblings give."""
    for side, other in path:
        node = sha256(other + node if side == LEFT else node + other).hexdigest().encode()
    return node


# --- tables of nodes -------------------------------------------------------------------------------

def _blocks(levels: int) -> list[Column]:
    return [F.expr(f"position div {1 << levels}").alias("block"), F.expr(f"position % {1 << levels}").alias("place")]


def _tops(nodes: DataFrame, levels: int) -> DataFrame:
    """The top node of each superblock, as a node of the round above."""
    def top(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        whole = int(group["n"].iloc[0])
        last = reduce_block([bytes(x) for x in group["node"]], whole, levels)[-1][0]
        number = int(group["block"].iloc[0])
        return pd.DataFrame({"tree": [group["tree"].iloc[0]], "block": [number >> levels],
                             "place": [number & ((1 << levels) - 1)], "n": [-(-whole >> levels)], "node": [last]})
    return nodes.groupBy("tree", "block").applyInPandas(top, NODE)


def _outer(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """``path`` from each node of a round to the root: siblings in its superblock, then the superblock's own path."""
    def joined(children: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        children = children.sort_values("place")
        rows = reduce_block([bytes(x) for x in children["node"]], int(children["n"].iloc[0]), levels)
        rest = bytes(outer["path"].iloc[0])
        return pd.DataFrame({"tree": children["tree"], "position": children["block"] * (1 << levels) + children["place"],
                             "path": [inner_path(rows, i) + rest for i in range(len(children))]})
    return nodes.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")) \
        .applyInPandas(joined, "tree string, position long, path binary")


def _forest(rounds: list[DataFrame], top: DataFrame, levels: int, scratch: support.Scratch) -> DataFrame:
    """Outer path of each superblock of the lowest round; ``top`` has what lies beyond each tree's root."""
    above = top
    for nodes in reversed(rounds[1:]):
        above = scratch.table(_outer(nodes, above, levels), "outer-nodes") \
            .select("tree", F.col("position").alias("block"), "path")
    return above


def _climb(leaves: DataFrame, most: int, levels: int, scratch: support.Scratch) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of nodes from the leaves up, and each tree's root."""
    rounds = [leaves]
    while True:
        tops = scratch.table(_tops(rounds[-1], levels), "nodes")
        most = -(-most >> levels)
        if most <= 1:
            return rounds, tops.select("tree", "node")
        rounds.append(tops)


def manifest(rows: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", doc_id: str = "doc_id",
             altered: dict[str, Column] | None = None, changed: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """Per row: id, ``leaf``, ``subroot`` of its tree, ``root``, ``proof_sha256``, ``folded_root`` and ``verified``.

    ``altered`` gives other values of fields where ``changed`` holds; such rows are folded from the altered leaf with
    the original siblings, so they are verified only if nothing has changed.
    """
    scratch = support.Scratch(rows.sparkSession)
    columns = [support.col(f) for f in fields]
    leaf = row_digest(columns)
    other = F.lit(None).cast("binary")
    if altered:
        changes = row_digest([altered.get(f, support.col(f)) for f in fields])
        other = F.when(changed, changes.cast("binary"))
    named = F.coalesce(F.concat(F.lit("="), support.col(tree)), F.lit(""))  # null first, then by bytes
    digests = rows.select(named.alias("tree"), support.col(doc_id).cast("long").alias("doc_id"),
                          leaf.cast("binary").alias("node"), other.alias("altered"))
    try:
        placed = support.placed(digests, "tree", [F.col("doc_id").asc_nulls_first(), F.col("node")], scratch, "leaves")
        leaves = scratch.table(placed.select("tree", *_blocks(levels), "n", "node", "doc_id", "altered"), "placed-leaves")
        most = leaves.agg(F.max("n")).first()[0]
        if most is None:
            return rows.sparkSession.createDataFrame([], ROW)
        rounds, roots = _climb(leaves.select("tree", "block", "place", "n", "node"), most, levels, scratch)

        ranked = support.placed(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node"), "tree",
                                [F.col("name")], scratch, "roots")
        trees = scratch.table(ranked.select("tree", *_blocks(levels), "n", "node", "name", "position"), "placed-roots")
        upper, root = _climb(trees.select("tree", "block", "place", "n", "node"),
                             trees.agg(F.max("n")).first()[0], levels, scratch)
        start = root.select("tree", F.lit(0).cast("long").alias("block"), F.lit(b"").alias("path"))
        beyond = _outer(trees.select("tree", "block", "place", "n", "node"),
                        _forest(upper, start, levels, scratch), levels)
        beyond = trees.select("name", "position", "node").join(beyond.drop("tree"), "position") \
            .select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), "path", F.col("node").alias("subroot"))
        beyond = scratch.table(beyond.withColumn("root", F.lit(root.first()["node"])), "tree-roots")

        outer = _forest(rounds, beyond.select("tree", "block", "path"), levels, scratch)
        outer = outer.join(beyond.select("tree", "subroot", "root"), "tree")
        by = ["tree", "block"]
        finished = leaves.groupBy(*by).cogroup(outer.groupBy(*by)).applyInPandas(_finisher(levels), ROW)
        return scratch.kept(finished, "manifest")
    finally:
        scratch.clear()


def _finisher(levels: int):
    """Local reduction, proofs and folding of one superblock with its outer nodes."""
    def finish(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        leaves = leaves.sort_values("place")
        nodes = [bytes(x) for x in leaves["node"]]
        rows = reduce_block(nodes, int(leaves["n"].iloc[0]), levels)
        rest, subroot, root = (bytes(outer[c].iloc[0]) for c in ("path", "subroot", "root"))
        proofs, folded = [], []
        for i, (node, other) in enumerate(zip(nodes, leaves["altered"])):
            path = list(steps(inner_path(rows, i) + rest))
            proofs.append(sha256(b"".join(sibling for _, sibling in path)).hexdigest())
            folded.append(fold(node if other is None else bytes(other), path).decode())
        return pd.DataFrame({
            "doc_id": leaves["doc_id"].astype("Int64"), "leaf": [n.decode() for n in nodes], "subroot": subroot.decode(),
            "root": root.decode(), "proof_sha256": proofs, "folded_root": folded,
            "verified": [f == root.decode() for f in folded]})
    return finish


def tampered_documents(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The manifest of documents, checked after ``n_chars`` grew by 1 where 7 divides the checksum of the id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    one_more = F.col("n_chars").cast("decimal(20,0)") + 1
    return manifest(docs, altered={"n_chars": one_more}, changed=hit, levels=levels)
