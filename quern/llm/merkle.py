"""A Merkle manifest of a dataset: a binary tree over each group's leaves, one more over the groups' roots, and for every
leaf its proof, folded and held against the root.

The trees are built by a combineByKey whose combiner is a frontier of partial parents: a child's digest arrives at its
parent, and once as many are there as the parent's arity (two, or one at the end of an odd level; it follows from the
group's size) the parent's digest is an event of its own and arrives one level up. Batches of leaves combine where they
lie; what stays unresolved is shuffled by its ancestor 12 levels up, combined there, and so on: a tree of n leaves takes
log2(n) / 12 rounds, and no task holds more than the frontiers of 4096 nodes. The reverse links then hand the siblings
down the same way: a block of nodes meets its ancestor's proof, and each node's own is the siblings inside plus that.

A group may hold any share of the rows: leaves are numbered by a range sort, whose runs are counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import cut, tidy
from quern.plans.models import sized

#: Levels that one round resolves: a block has 2 ** LEVELS nodes.
LEVELS = 12


def encoded(c: Column) -> Column:
    """A value as the leaf's digest takes it: - for null, else its UTF-8 bytes' number, a colon, and itself."""
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def digest(*values: Column) -> Column:
    """The SHA-256 (32 bytes) of the encoded values."""
    return F.unhex(F.sha2(F.concat(*[encoded(v) for v in values]), 256))


def H(*children: bytes) -> bytes:
    """A node's digest: of its children's digests as hexadecimal text."""
    return hashlib.sha256(b"".join(c.hex().encode() for c in children)).digest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    return max(0, (n - 1).bit_length())


def width(n: int, level: int) -> int:
    """Nodes of a level."""
    return (n + (1 << level) - 1) >> level


class Frontier:
    """The combiner: children that wait for their siblings, by parent, and the nodes that reached the top level."""

    def __init__(self, n: int, top: int, keep: bool = False):
        self.n, self.top, self.waiting, self.done = n, min(top, height(n)), {}, []
        self.nodes: dict | None = {} if keep else None

    def arrive(self, level: int, j: int, node: bytes) -> None:
        """Takes a node in any order, and emits each ancestor whose children are then complete."""
        while True:
            if self.nodes is not None:
                self.nodes[level, j] = node
            if level >= self.top:
                self.done.append((level, j, node))
                return
            children = self.waiting.setdefault((level, j >> 1), {})
            children[j] = node
            if len(children) < min(2, width(self.n, level) - (j >> 1 << 1)):
                return
            del self.waiting[level, j >> 1]
            level, j, node = level + 1, j >> 1, H(*(children[k] for k in sorted(children)))

    def unresolved(self) -> Iterator[tuple[int, int, bytes]]:
        yield from self.done
        for (level, _), children in self.waiting.items():
            for j, node in children.items():
                yield level, j, node

    def siblings(self, level: int, j: int) -> bytes:
        """The siblings on the way from a node up to the top, one after the other."""
        found = b""
        while level < self.top:
            found += self.nodes.get((level, j ^ 1), b"")
            level, j = level + 1, j >> 1
        return found


def folded(node: bytes, j: int, n: int, siblings: bytes) -> bytes:
    """The root that a leaf (the j-th of n) and its siblings give."""
    at = 0
    for level in range(height(n)):
        if j ^ 1 < width(n, level):
            other = siblings[at : at + 32]
            at += 32
            node = H(other, node) if j & 1 else H(node, other)
        else:
            node = H(node)
        j >>= 1
    return node


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``j``, each row's place from 0 in its group ``g`` (a string without nulls) by ``order`` (ascending, nulls
    first), and ``n``, the group's rows. Equal rows take consecutive places. Rows are sorted by ranges, in which a large
    group or many equal rows are split; the ranges' runs are counted (a row for each range and group) and joined."""
    rows = rows.withColumn("salt", F.monotonically_increasing_id())
    by = [F.col(c).asc_nulls_first() for c in ("g", *order, "salt")]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("salt")
    # ids that ascend within a partition number its rows as they are sorted
    dealt = cut(dealt.withColumn("p", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    runs = dealt.groupBy("g", "p").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("begin"))
    group = Window.partitionBy("g")  # a row for each range of the sort at most
    runs = runs.select("g", "p", "begin", F.sum("c").over(group).alias("n"), F.coalesce(F.sum("c").over(group.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("skip"))
    return dealt.join(sized(cut(runs)), ["g", "p"]).withColumn("j", F.col("skip") + F.col("at") - F.col("begin")).drop("p", "at", "begin", "skip")


NODES = "g string, n long, level int, j long, digest binary"


def _block(lo: int) -> Column:
    """The ancestor, LEVELS above level ``lo``, whose task a node goes to."""
    return F.expr(f"shiftright(j, {lo + LEVELS} - level)").alias("block")


def _rows(b: pa.RecordBatch | pa.Table) -> Iterator[tuple]:
    return zip(*(b.column(c).to_pylist() for c in ("g", "n", "level", "j", "digest")))


def _batch(rows: list[tuple], names: str, kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names.split())


_KINDS = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]


def combine(nodes: DataFrame, lo: int) -> DataFrame:
    """One round: nodes of level ``lo`` (or their groups' roots, below it) combined LEVELS up, or to the root."""

    def merge(rows: Iterator[tuple]) -> list[tuple]:
        fronts: dict[tuple, Frontier] = {}
        for g, n, level, j, node in rows:
            key = g, n, j >> (lo + LEVELS - level)
            (fronts.get(key) or fronts.setdefault(key, Frontier(n, lo + LEVELS))).arrive(level, j, node)
        return [(g, n, *x) for (g, n, _), f in fronts.items() for x in f.unresolved()]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch(merge(_rows(b)), "g n level j digest", _KINDS)

    def far(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_batch(merge(_rows(t)), "g n level j digest", _KINDS)])

    partial = nodes.select("g", "n", "level", "j", "digest").mapInArrow(tidy(near), NODES).select("*", _block(lo))
    return cut(partial.groupBy("g", "block").applyInArrow(far, NODES))


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """The nodes that each round starts from, and at last the groups' roots."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    out, lo = [nodes], 0
    while lo < height(most):
        out.append(combine(out[-1], lo))
        lo += LEVELS
    return out


PATHS = "g string, j long, path binary"


def descend(nodes: DataFrame, lo: int, above: DataFrame) -> DataFrame:
    """(g, j, path): the siblings from each node of level ``lo`` up to its group's root, from those of the nodes LEVELS up."""

    def expand(own: pa.Table, up: pa.Table) -> pa.Table:
        rows = list(_rows(own))
        f, path = filled(rows, lo), up.column("path")[0].as_py() if rows else b""
        return pa.Table.from_batches([_batch([(g, j, f.siblings(level, j) + path) for g, _, level, j, _ in rows], "g j path", [pa.string(), pa.int64(), pa.binary()])])

    own, up = nodes.select("*", _block(lo)), above.withColumn("block", F.col("j"))
    return cut(own.groupBy("g", "block").cogroup(up.groupBy("g", "block")).applyInArrow(expand, PATHS))


def filled(rows: list[tuple], lo: int) -> Frontier | None:
    """A block's frontier with all its nodes."""
    f = Frontier(rows[0][1], lo + LEVELS, keep=True) if rows else None
    for _, _, level, j, node in rows:
        f.arrive(level, j, node)
    return f


def paths(levels: list[DataFrame], to: int) -> DataFrame:
    """(g, j, path) of the nodes that round ``to`` starts from; levels: as ``rounds`` gives them."""
    found = levels[-1].select("g", "j", F.lit(b"").alias("path"))
    for r in range(len(levels) - 2, to - 1, -1):
        found = descend(levels[r], r * LEVELS, found)
    return found


OUT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(leaves: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row for each of leaves (doc_id long, grp
    string, leaf binary, shown binary), digests as lowercase hexadecimal text.

    A group's leaves ascend by doc_id (null first; rows of one doc_id by leaf, then by shown); groups ascend bytewise, null
    first. proof_sha256 is of the siblings from the leaf to the root, as hexadecimal text; folded_root is what ``shown``
    (null: the leaf) and these siblings give, verified whether that is the root.

    A lone leaf is its group's root, a lone group's root the root; then proofs are empty. Equal rows are leaves of their
    own. An empty table gives no rows. Other columns are left out.
    """
    group = F.coalesce(F.concat(F.lit("="), F.col("grp")), F.lit("-"))  # null first, and no null
    rows = leaves.select(F.col("doc_id").cast("long").alias("doc_id"), group.alias("g"), F.col("leaf").alias("digest"), F.coalesce("shown", "leaf").alias("shown"))
    rows = cut(numbered(rows, ["doc_id", "digest", "shown"]).withColumn("level", F.lit(0)))
    levels = rounds(rows)
    roots = levels[-1].select(F.lit("").alias("g"), F.col("g").alias("grp"), "digest")
    roots = cut(numbered(roots, ["grp"]).withColumn("level", F.lit(0)))
    crown = rounds(roots)
    top = crown[-1].select("digest").first()  # one row: the root
    root = F.lit(bytes(top[0]) if top else None).cast("binary").alias("root")
    # a row for each group: its root, its place among them, and the siblings from there up
    tops = roots.join(paths(crown, 0).select("j", F.col("path").alias("crown")), "j")
    tops = tops.select(F.col("grp").alias("g"), F.col("digest").alias("subroot"), F.col("j").alias("k"), F.col("n").alias("groups"), "crown", root)
    if len(levels) == 1:  # no group has two leaves
        above = rows.select(F.col("g").alias("g"), F.lit(0).cast("long").alias("j"), F.lit(b"").alias("path")).distinct()
    else:
        above = paths(levels, 1)
    above = above.join(tops, "g").withColumn("block", F.col("j"))
    own = rows.select("*", _block(0))
    return own.groupBy("g", "block").cogroup(above.groupBy("g", "block")).applyInArrow(_proofs, OUT)


def _proofs(own: pa.Table, up: pa.Table) -> pa.Table:
    rows, out = list(_rows(own)), []
    names = "doc_id leaf subroot root proof_sha256 folded_root verified"
    kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    if rows:
        f, u = filled(rows, 0), {c: up.column(c)[0].as_py() for c in ("path", "subroot", "k", "groups", "crown", "root")}
        subroot, root = u["subroot"].hex(), u["root"].hex()
        for (_, n, _, j, leaf), doc_id, shown in zip(rows, own.column("doc_id").to_pylist(), own.column("shown").to_pylist()):
            siblings = f.siblings(0, j) + u["path"]
            got = folded(folded(shown, j, n, siblings), u["k"], u["groups"], u["crown"])
            proof = hashlib.sha256((siblings + u["crown"]).hex().encode()).hexdigest()
            out.append((doc_id, leaf.hex(), subroot, root, proof, got.hex(), got == u["root"]))
    return pa.Table.from_batches([_batch(out, names, kinds)])
