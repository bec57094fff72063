"""Merkle manifest of a dataset with incremental witnesses.

Rows are leaves, ordered by id inside their language; two neighbours at a time become their hash until one node, the
subroot, is left, and the subroots, ordered by language, become the root the same way. A *witness* is what leads from
a leaf to the root: on each level the sibling and its side, or nothing where a node is alone.

Leaves are numbered in their language and cut into aligned blocks of ``1 << LEVELS``. A task appends the nodes of a
block one after another: finished subtrees of equal height join, and the witnesses of the members of both are extended
by the other's digest; what stays open at the end is closed by lone nodes. Block roots are further appends, block by
block of them, until every language has one node; then the subroots are. Downwards, a node's witness goes on with the
witness of its block, which comes to the task as the block's first row, so no witness of a leaf is ever shuffled.

No task holds more than one block, whatever the language's share; rows are numbered by ``prefix_over`` (range
partitions and offsets). Every table read twice is written first.

Defined results: a null or empty field is a leaf part of its own (``-`` or ``0:``); null languages form a tree, which
comes first; null ids come first in theirs and are never tampered with; rows that share an id are ordered by leaf,
and equal rows are leaves each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import prefix_over
from ..session import cut_lineage

LEVELS = 12  # a block holds at most 2 ** LEVELS nodes
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ALONE, RIGHT, LEFT = "A", "R", "L"  # a step: alone, or the sibling's side and digest
EMITTED = 4096


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values: dict[str, Column]) -> Column:
    """sha256 of all fields, each ``-`` or its bytes' number, ``:`` and the value."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(values[c]).cast("string"), F.lit(":"), values[c]),
                                        F.lit("-")) for c in FIELDS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf and tampered (the leaf with n_chars + 1 where the tampering rule says so, else null)."""
    values = {"doc_id": F.col("doc_id").cast("long").cast("string"), "source": F.col("source").cast("string"),
              "lang": F.col("lang").cast("string"), "n_chars": F.col("n_chars").cast("long").cast("string"),
              "text": F.col("text").cast("string")}
    changed = values | {"n_chars": (F.col("n_chars").cast("long").cast("decimal(20,0)") + 1).cast("decimal(20,0)").cast("string")}
    chosen = (F.pmod(F.crc32(values["doc_id"]), F.lit(7)) == 0) & F.col("n_chars").isNotNull()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), values["lang"].alias("lang"),
                       leaf_of(values).alias("leaf"), F.when(chosen, leaf_of(changed)).alias("tampered"))


class Block:
    """Nodes appended to one aligned block, and the witness of each so far."""

    def __init__(self, witnesses: bool = True):
        self.witnesses: list[list[str]] | None = [] if witnesses else None
        self.open: list[tuple[int, str, int]] = []  # height, digest, first member of every subtree without a sibling
        self.n = 0

    def extend(self, first: int, last: int, step: str) -> None:
        if self.witnesses is not None:
            for witness in self.witnesses[first:last]:
                witness.append(step)

    def join(self) -> None:
        """The last two open subtrees become one; each completes the other's members' witnesses."""
        height, right, middle = self.open.pop()
        _, left, first = self.open.pop()
        self.extend(first, middle, RIGHT + right)
        self.extend(middle, self.n, LEFT + left)
        self.open.append((height + 1, digest(left + right), first))

    def append(self, node: str, steps: int = 0) -> None:
        """Add a node, first raised as a lone one by ``steps`` levels."""
        for _ in range(steps):
            node = digest(node)
        if self.witnesses is not None:
            self.witnesses.append([ALONE] * steps)
        self.open.append((0, node, self.n))
        self.n += 1
        self.settle()

    def settle(self) -> None:
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            self.join()

    def close(self) -> tuple[str, int]:
        """(root, height) of the nodes appended."""
        while len(self.open) > 1:
            height, node, first = self.open.pop()
            self.extend(first, self.n, ALONE)
            self.open.append((height + 1, digest(node), first))
            self.settle()
        return self.open[0][1], self.open[0][0]


def folded(node: str, witness: list[str]) -> str:
    """The root that a leaf and its witness lead to."""
    for step in witness:
        side, sibling = step[0], step[1:]
        node = digest(node if side == ALONE else node + sibling if side == RIGHT else sibling + node)
    return node


def proof(witness: list[str]) -> str:
    return digest("".join(step[1:] for step in witness))


def raised(pos: int, height: int | None, levels: int) -> int:
    """Lone steps of a block's root before its level: an unfinished block is raised, if it isn't its tree's only one."""
    return 0 if height is None or pos == 0 else levels - height


def streamed(nodes: DataFrame, levels: int, out: str, row: Callable, header: DataFrame | None = None) -> DataFrame:
    """``row(block, rows, head)`` of every block of ``nodes`` (grp, pos, node, height and others), a list of tuples.
    ``header`` (grp, block, witness, subroot, root) has a row for each block, which comes to the task first."""
    block = F.shiftright("pos", levels)
    rows = nodes.withColumn("block", block).withColumn("kind", F.lit(1))
    if header is not None:
        rows = rows.unionByName(header.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    columns = rows.columns
    at = {c: i for i, c in enumerate(columns)}
    names = [c.split()[0] for c in out.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[c.split()[1]]
             for c in out.split(", ")]
    with_header = header is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key, tree, members, head = None, None, [], None

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

        for batch in batches:
            for values in zip(*[c.to_pylist() for c in batch.columns]):
                here = values[at["grp"]], values[at["block"]]
                if here != key:
                    if members:
                        held += row(tree, members, head)
                        if len(held) >= EMITTED:
                            yield emit()
                            held = []
                    key, tree, members, head = here, Block(with_header), [], None
                if values[at["kind"]] == 0:
                    head = {c: values[i] for c, i in at.items()}
                    continue
                member = {c: values[i] for c, i in at.items()}
                tree.append(member["node"], raised(member["pos"], member["height"], levels))
                members.append(member)
        if members:
            held += row(tree, members, head)
        if held:
            yield emit()

    return (rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "kind", "pos").select(*columns)
            .mapInArrow(run, out))


def blocks_of(nodes: DataFrame, levels: int) -> DataFrame:
    """grp, pos, node, height: the roots of the blocks of ``nodes``."""
    def row(tree: Block, members: list[dict], _) -> list[tuple]:
        root, height = tree.close()
        return [(members[0]["grp"], members[0]["block"], root, height)]

    return cut_lineage(streamed(nodes.select("grp", "pos", "node", "height"), levels,
                                "grp string, pos long, node string, height int", row), name="op12-blocks")


def levels_of(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """``nodes``, the roots of their blocks, the roots of those blocks, and so on to one node a group."""
    out = [nodes, blocks_of(nodes, levels)]
    while (out[-1].agg(F.max("pos")).first()[0] or 0) > 0:
        out.append(blocks_of(out[-1], levels))
    return out


def witnesses_of(nodes: DataFrame, header: DataFrame, levels: int) -> DataFrame:
    """grp, block, witness, subroot, root for the blocks whose roots ``nodes`` are."""
    def row(tree: Block, members: list[dict], head: dict) -> list[tuple]:
        tree.close()
        rest = head["witness"].split() if head["witness"] else []
        return [(m["grp"], m["pos"], " ".join(w + rest), head["subroot"], head["root"])
                for m, w in zip(members, tree.witnesses)]

    return streamed(nodes.select("grp", "pos", "node", "height"), levels,
                    "grp string, block long, witness string, subroot string, root string", row, header)


def manifest(docs: DataFrame, with_witness: bool = False, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row; with ``with_witness`` also lang and
    witness (steps from leaf to root: ``A``, ``R<right sibling>``, ``L<left sibling>``)."""
    written = cut_lineage(leaves(docs).withColumn("row", F.monotonically_increasing_id()), name="op12-leaves")
    numbered = prefix_over(written, ["lang"], ["doc_id", "leaf", "row"], index_name="pos").select(
        F.col("lang").alias("grp"), "pos", F.col("leaf").alias("node"), F.lit(None).cast("int").alias("height"),
        "doc_id", "tampered")
    trees = levels_of(numbered, levels)
    roots = prefix_over(trees[-1].select(F.lit("all").alias("tree"), F.col("grp").alias("lang"), "node"), ["tree"], ["lang"],
                        index_name="pos")
    roots = cut_lineage(roots, name="op12-subroots")
    top = levels_of(roots.select(F.col("tree").alias("grp"), "pos", "node", F.lit(None).cast("int").alias("height")), levels)
    # the root alone is the whole tree's one block; from there down every level's blocks get their witnesses
    header = top[-1].select("grp", F.col("pos").alias("block"), F.lit("").alias("witness"), F.lit("").alias("subroot"),
                            F.col("node").alias("root"))
    for nodes in top[-2:0:-1]:
        header = witnesses_of(nodes, header, levels)
    ways = witnesses_of(top[0], header, levels)
    header = roots.join(ways, F.col("block") == F.col("pos")).select(
        F.col("lang").alias("grp"), F.lit(0).cast("long").alias("block"), "witness", F.col("node").alias("subroot"), "root")
    for nodes in trees[-2:0:-1]:
        header = witnesses_of(nodes, header, levels)
    header = cut_lineage(header, name="op12-witnesses")

    def row(tree: Block, members: list[dict], head: dict) -> list[tuple]:
        tree.close()
        rest = head["witness"].split() if head["witness"] else []
        out = []
        for m, witness in zip(members, tree.witnesses):
            way = witness + rest
            end = folded(m["tampered"] or m["node"], way)
            out.append((m["doc_id"], m["node"], head["subroot"], head["root"], proof(way), end, end == head["root"],
                        *((m["grp"], " ".join(way)) if with_witness else ())))
        return out

    return streamed(numbered, levels, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
                              "folded_root string, verified boolean" + (", lang string, witness string" if with_witness else ""),
                    row, header)
