"""Merkle manifest of a dataset: a tree per group, a tree over the groups, and a proof for each row.

Leaves of a group lie in order of id; every ``arity`` consecutive nodes (the last run: fewer, even one) become their parent
while more than one remains. Each level of a block takes lag and lead columns at fixed offsets (1 to arity - 1 nodes), masked by the node's slot in its
run and by what the run holds: they are a node's siblings; rows of first children hash the parents.

A window never holds a group: a row's place in its group comes from ``positions``, and windows run within aligned blocks of
a power of arity, 4,096 rows at most. Blocks of one power are whole subtrees, so their nodes are the leaves of the
next, far shorter table, and so on; a group of any size is spread over its blocks. Proofs come down again by joins on (group, block).

A digest is lowercase hexadecimal sha256 of its inputs, one behind the other, digests as text.

Defined results: a null field is '-', an empty one '0:'; null ids and null groups come first; rows of one id follow one another in order of
leaf; a lone leaf is its group's root, a lone group's root the root; an empty table gives no rows; other columns are kept only where they are named.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.positions import positions
from tessera.llm.tables import stored

#: Rows of a block, and rows of a group beyond which its figures are sent to all tasks.
BLOCK, LARGE_GROUP = 4096, 1_000_000
PATH = "array<struct<left:string,right:string>>"


def leaf(*fields: Column) -> Column:
    """Digest of a row's fields: '-' for null, else the number of UTF-8 bytes, a colon and the value."""
    printed = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*printed), 256)


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    return F.aggregate(path, digest, lambda d, step: F.sha2(F.concat(step["left"], d, step["right"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a path, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def _climbed(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """Nodes (g, pos, n, hash, ...) with their block, the steps of their path within it, and at its first row the block's ``node``."""
    rows = nodes.withColumns({"block": F.floor(F.col("pos") / arity**levels).cast("long"), "node": F.col("hash")})
    order = Window.partitionBy("g", "block").orderBy("pos")
    for level in range(levels):
        step = arity**level
        slot = F.floor(F.col("pos") / step) % arity
        lags = {f"lag{j}": F.lag("node", j * step).over(order) for j in range(1, arity)}
        rows = rows.withColumns(lags | {f"lead{j}": F.lead("node", j * step).over(order) for j in range(1, arity)})
        left = F.concat(*[F.when(slot >= j, F.coalesce(f"lag{j}", F.lit(""))).otherwise("") for j in range(arity - 1, 0, -1)])
        right = F.concat(*[F.when(slot + j < arity, F.coalesce(f"lead{j}", F.lit(""))).otherwise("") for j in range(1, arity)])
        above = F.col("n") > step  # more than one node on this level
        taken = F.when(above & (F.col("pos") % step == 0), F.struct(left.alias("left"), right.alias("right")))
        parent = F.when(F.col("pos") % (step * arity) == 0, F.when(above, F.sha2(F.concat(F.col("node"), right), 256)).otherwise(F.col("node")))
        rows = rows.withColumns({f"step{level}": taken, "node": parent}).drop(*lags, *[f"lead{j}" for j in range(1, arity)])
    # a step stands at the first row of its node; the other rows of the node take it from there
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spread = F.array(*[F.last(f"step{level}", ignorenulls=True).over(so_far) for level in range(levels)])
    return rows.withColumn("path", F.filter(spread, lambda s: s.isNotNull())).drop(*[f"step{level}" for level in range(levels)])


def paths(nodes: DataFrame, arity: int, tops: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Paths of nodes (g, pos, n, hash, ...) up to their group's top node, and on as ``tops`` says.

    tops gets (g, hash) of the top nodes and gives (g, path, ...): what to add to every path of g, and other columns.
    """
    levels = max(k for k in range(1, 13) if k == 1 or arity**k <= BLOCK)
    tables = []
    while True:
        tables.append(stored(_climbed(nodes, arity, levels), "climbed"))
        heads = tables[-1].where(F.col("node").isNotNull()).select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / arity**levels).cast("long").alias("n"), F.col("node").alias("hash"))
        if not tables[-1].where(F.col("n") > arity**levels).limit(1).count():
            break
        nodes = heads
    above = tops(heads.select("g", "hash")).withColumn("block", F.lit(0).cast("long"))
    for table in reversed(tables):  # a block's rows share what is above it
        joined = table.drop("hash", "node").join(above.withColumnRenamed("path", "rest"), ["g", "block"])
        above = joined.withColumn("path", F.concat("path", "rest")).drop("rest", "block").withColumnRenamed("pos", "block")
        if table is not tables[0]:
            above = above.drop("n")
    return above.withColumnRenamed("block", "pos")


def build(docs: DataFrame, fields: tuple[str, ...], id_col: str = "doc_id", group_col: str = "lang", keep: tuple[str, ...] = (), arity: int = 2) -> DataFrame:
    """(leaf, subroot, root, path, the kept columns) of every row; fields are what a leaf covers, in order."""
    rows = docs.select(
        F.col(f"`{group_col}`").cast("string").alias("group"), F.col(f"`{id_col}`").alias("id"), leaf(*[F.col(f"`{c}`") for c in fields]).alias("hash"), *[F.col(f"`{c}`").alias(f"kept_{k}") for k, c in enumerate(keep)]
    )
    placed = stored(positions(rows, ["group", "id", "hash"]), "placed")
    groups = positions(placed.groupBy("group").agg(F.min("rows_before").alias("start"), F.count("*").alias("n")), ["group"]).withColumnRenamed("rows_before", "g")
    groups = stored(groups.withColumnRenamed("group", "name"), "groups")
    same = F.col("group").eqNullSafe(F.col("name"))
    # rows by LARGE_GROUP bound the large groups' table; small groups are keys of that many rows at most
    large, small = groups.where(F.col("n") > LARGE_GROUP), groups.where(F.col("n") <= LARGE_GROUP)
    met = placed.join(F.broadcast(large), same)
    met = met.unionByName(placed.join(F.broadcast(large.select("name")), same, "left_anti").join(small, same))
    leaves = met.withColumn("pos", F.col("rows_before") - F.col("start")).select("g", "pos", "n", "hash", F.col("hash").alias("leaf"), *[c for c in rows.columns if c.startswith("kept_")])

    def root(tops: DataFrame) -> DataFrame:
        tops = stored(tops, "tops")
        lone = tops.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), F.lit(tops.count()).alias("n"), "hash", F.col("hash").alias("subroot"))
        done = paths(lone, arity, lambda top: top.select("g", F.array().cast(PATH).alias("path"), F.col("hash").alias("root")))
        return done.select(F.col("pos").alias("g"), "path", "subroot", "root")

    out = paths(leaves, arity, root)
    return out.select("leaf", "subroot", "root", "path", *[F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)])
