"""Merkle manifest of a dataset: a root, and a proof for every row.

Leaves hash a row's fields. Per group (source) the leaves stand in order of id, and runs of three nodes
have a parent until one is left, the group's subroot; subroots in order of their groups give the root
by the same rule.

Of a tree only every few levels are stored (``every``; 4 levels are aligned subtrees of 81 nodes): one
row per subtree with its nodes in order. To extract proofs, the levels between are computed again
inside each subtree, the siblings are handed down, and the interior nodes are forgotten. A proof is a
list of steps from the leaf to the root, each with the digests left and right of the node in its run.

How it scales: leaves are dealt by ranges of (group, id), so a group with a third of all rows spreads over
many tasks; positions come from the rows' places in the stored, sorted partitions and the counts of
the partitions before, one row per group and partition. A task then holds single subtrees, which are
bounded. Everything is DataFrame functions; stored tables lie below the shared folder and outlive any
executor. The driver sees one number per level, the largest count of nodes.

Defined cases: a null field hashes as ``-``; a null group comes first, and a null id comes first in its
group; rows of one id stand in order of their leaf hash, and whole copies one after the other; a lone
leaf is its group's subroot, and a lone subroot the root; a table without rows gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.session import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN, EVERY = 3, 4
NO_STEPS = "cast(array() as array<struct<left: string, right: string>>)"
SCHEMA = "doc_id long, leaf string, claim string, subroot string, root string, steps array<struct<left: string, right: string>>"


def digest(*parts: Column | str) -> Column:
    """Lowercase hex sha256 of the inputs, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame, claimed: Mapping[str, Column] | None = None, only: Column | None = None) -> DataFrame:
    """doc_id, tree (the group as text that sorts like it), leaf, and the leaf of claimed values.

    ``claimed`` names columns and what somebody says is in them, for the rows where ``only`` holds.
    """
    original = {c: F.col(c) for c in FIELDS}
    leaf = digest(*[field(c) for c in original.values()])
    claim = F.lit(None).cast("string")
    if claimed:
        claim = F.when(F.lit(True) if only is None else only, digest(*[field(c) for c in (original | dict(claimed)).values()]))
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return docs.select(
        tree.alias("tree"), leaf.alias("leaf"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), claim.alias("claim")).alias("payload")
    )


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Nodes with ``pos``, their place in the tree by ``order``, and ``n``, the tree's number of nodes.

    Runs jobs: the nodes are stored as they come and once more sorted.
    """
    came = written(nodes.withColumn("came", F.monotonically_increasing_id()), "merkle-nodes")
    by = ["tree", *order, "came"]
    dealt = came.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    dealt = written(dealt.drop("came"), "merkle-sorted").withColumn("part", F.shiftright("at", 33))
    parts = dealt.groupBy("tree", "part").agg(F.min("at").alias("head"), F.count("*").alias("rows"))
    whole = Window.partitionBy("tree")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select(
        "tree", "part", (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("head")).alias("shift"), F.sum("rows").over(whole).alias("n")
    )
    return dealt.join(shifts, ["tree", "part"]).select("tree", "n", (F.col("at") + F.col("shift")).alias("pos"), "leaf", "payload")


def parents(nodes: Column) -> Column:
    """The digests of each run of three; the last run can be shorter."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / RUN).cast("int") - 1)
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * RUN + 1, F.lit(RUN)), ""), 256))


def subtrees(nodes: DataFrame, every: int) -> DataFrame:
    """One row per aligned subtree with its nodes in order: what is stored of a level."""
    block = F.expr(f"pos div {RUN**every}").alias("block")
    node = F.struct("pos", *[c for c in ("leaf", "payload") if c in nodes.columns])
    return nodes.groupBy("tree", "n", block).agg(F.sort_array(F.collect_list(node)).alias("nodes"))


def regenerated(stored: DataFrame, every: int) -> DataFrame:
    """Adds ``h0`` to ``h<every>``, the levels of each subtree, and ``up``, how many there are above h0."""
    more = [F.when(F.col("n") > RUN**s, 1).otherwise(0) for s in range(every)]
    out = stored.withColumn("up", sum(more[1:], more[0])).withColumn("h0", F.col("nodes.leaf"))
    for s in range(every):
        out = out.withColumn(f"h{s + 1}", F.when(F.col("up") > s, parents(F.col(f"h{s}"))).otherwise(F.col(f"h{s}")))
    return out


@dataclass
class Forest:
    """The stored levels of some trees, lowest first, and the top node of each tree."""

    stored: list[DataFrame]
    tops: DataFrame | None
    every: int


def grow(nodes: DataFrame, every: int, keep: Callable[[DataFrame, str], DataFrame]) -> Forest:
    """Store every ``every``-th level, from the leaves on.

    Runs two jobs per stored level.
    """
    stored: list[DataFrame] = []
    tops: DataFrame | None = None
    while True:
        table = keep(subtrees(nodes, every), "merkle-level")
        most = table.agg(F.max("n")).first()[0]
        if most is None:
            return Forest(stored, tops, every)
        stored.append(table)
        made = regenerated(table, every).select("tree", "n", F.col("block").alias("pos"), F.element_at(f"h{every}", 1).alias("leaf"))
        ended = made.where(F.col("n") <= RUN**every).select("tree", F.col("leaf").alias("top"))
        tops = ended if tops is None else tops.unionByName(ended)
        if most <= RUN**every:
            return Forest(stored, tops, every)
        n = F.ceil(F.col("n") / RUN**every).alias("n")
        nodes = made.where(F.col("n") > RUN**every).select("tree", n, "pos", "leaf")


def steps_of(i: Column, every: int) -> Column:
    """The steps from the subtree's ``i``-th lowest node to its top."""
    levels = F.slice(F.array(*[f"h{s}" for s in range(every)]), F.lit(1), F.col("up"))
    width = F.array(*[F.lit(RUN**s) for s in range(every)])

    def step(nodes: Column, s: Column) -> Column:
        at = F.floor(i / F.element_at(width, s + 1)).cast("int")
        first = at - at % RUN
        left = F.array_join(F.slice(nodes, first + 1, at - first), "")
        right = F.array_join(F.slice(nodes, at + 2, first + RUN - 1 - at), "")
        return F.struct(left.alias("left"), right.alias("right"))

    return F.transform(levels, step)


def proofs(forest: Forest, above: DataFrame) -> DataFrame:
    """Every lowest node with its payload, the steps to its tree's top and on, and ``above``'s columns.

    ``above`` has one row per tree: ``steps`` from its top onwards, and a struct ``known``.
    """
    found = None
    for level, table in reversed(list(enumerate(forest.stored))):
        whole = table.where(F.col("n") <= RUN**forest.every).join(above, "tree")
        if found is not None:
            cut = table.where(F.col("n") > RUN**forest.every)
            whole = whole.unionByName(cut.join(found.withColumnRenamed("pos", "block"), ["tree", "block"]).select(whole.columns))
        made = regenerated(whole, forest.every)
        kept = ["leaf", "payload"] if level == 0 else ["pos"]
        found = made.select(F.inline(F.transform("nodes", with_steps(kept, forest.every))))
    return found


def with_steps(kept: list[str], every: int) -> Callable[[Column, Column], Column]:
    """A node's row, from the node and its place in the subtree."""

    def row(node: Column, i: Column) -> Column:
        steps = F.concat(steps_of(i, every), F.col("steps")).alias("steps")
        return F.struct("tree", *[node[c].alias(c) for c in kept], steps, "known")

    return row


def manifest(
    docs: DataFrame, claimed: Mapping[str, Column] | None = None, only: Column | None = None, every: int = EVERY
) -> DataFrame:
    """One row per row of ``docs``: its leaf, claimed leaf (else null), subroot, root, and steps to the root.

    Runs jobs: leaves and stored levels are written below the shared folder.
    """
    spark = docs.sparkSession
    sources = grow(placed(leaves(docs, claimed, only), ["payload.doc_id", "leaf"]), every, written)
    if sources.tops is None:
        return spark.createDataFrame([], SCHEMA)
    subroots = sources.tops.select(F.lit("").alias("tree"), F.col("top").alias("leaf"), F.struct(F.col("tree").alias("source")).alias("payload"))
    whole = grow(placed(subroots, ["payload.source"]), every, written)
    root = whole.tops.select("tree", F.expr(NO_STEPS).alias("steps"), F.struct(F.col("top").alias("root")).alias("known"))
    above = proofs(whole, root).select(
        F.col("payload.source").alias("tree"), "steps", F.struct(F.col("leaf").alias("subroot"), F.col("known.root").alias("root")).alias("known")
    )
    return proofs(sources, written(above, "merkle-above")).select(
        "payload.doc_id", "leaf", "payload.claim", "known.subroot", "known.root", "steps"
    )


def siblings(steps: Column | str) -> Column:
    """The proof's digests, level by level and left to right, as one text."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf: Column, steps: Column | str) -> Column:
    """The root that a leaf and its steps give."""
    return F.aggregate(steps, leaf, lambda h, s: digest(s["left"], h, s["right"]))


def without_newlines(docs: DataFrame) -> tuple[dict[str, Column], Column]:
    """What the audit claims: texts without line ends, where the id's crc32 is even; never for a null id."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}, crc % 2 == 0


def audit(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """The manifest's digests, and whether each row, tampered with in half the cases, still verifies."""
    claimed, only = without_newlines(docs)
    made = manifest(docs, claimed, only, every)
    fold = folded(F.coalesce("claim", "leaf"), "steps")
    return made.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings("steps"), 256).alias("proof_sha256"), fold.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
