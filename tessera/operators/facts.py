"""Clusters of texts that say one thing: likeness by vectors and shared terms, labels with their support, cores, anchors, clusters of one fact.

Likeness of two rows is the product of their vectors (of length one) plus a bonus for each term that both have, one at most. As the
bound isn't additive, clusters are compared by the means of their vectors and by those pairs of rows alone that share a term; where a topic is too large for
a task by their rows: all rows of a cluster lie in one block, every row of the topic passes every block,
and sums of likeness by pairs of clusters stay within the task. Merging mutual nearest clusters gives what merging the nearest pair first does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.diverse import BLOCK, LOCAL, TIMES, by_topic, paired, symmetric
from tessera.sources.tables import stored

# Topics that a term may be in and still say something, the topic's size from which on a fact needs two sets, and shares.
VAGUE, LARGE_TOPIC, FEW_SETS, HALF = 50, 6, 2, 2
#: Lengths of vectors up to which the bound matters to pairs with a shared term or equal vectors only; pairs of rows that are looked at together.
UNIT, PAIRS = 1 + 1e-6, 1 << 20
ROW = "topic long, node long, n long, vector array<double>, terms array<long>"


def rows_with(terms: list[np.ndarray]) -> dict[int, np.ndarray]:
    """The rows that have each term."""
    places: dict[int, list[int]] = {}
    for k, ts in enumerate(terms):
        for t in ts.tolist():
            places.setdefault(t, []).append(k)
    return {t: np.array(p) for t, p in places.items()}


def likeness(vectors: np.ndarray, terms: list[np.ndarray], others: np.ndarray, having: dict[int, np.ndarray], bonus: float) -> np.ndarray:
    """Products of vectors plus bonus for each shared term, one at most; terms are distinct numbers, ``having`` the others' rows by term."""
    like = vectors @ others.T
    for i, ts in enumerate(terms):
        for t in ts.tolist():
            if t in having:
                like[i, having[t]] += bonus
    return np.minimum(like, 1.0)


def chained(apart: np.ndarray, n: np.ndarray, threshold: float) -> np.ndarray:
    """The first row of each row's cluster by average linkage of a table of distances between rows that count n times; the table is used up."""
    n, root, live = n.astype(float), np.arange(len(n)), np.ones(len(n), bool)
    np.fill_diagonal(apart, np.inf)
    chain: list[int] = []
    while live.any():  # along nearest clusters until two are each other's
        chain = chain or [int(np.argmax(live))]
        top = chain[-1]
        near = int(np.argmin(apart[top]))
        if len(chain) > 1 and apart[top, chain[-2]] <= apart[top, near] + 1e-12:
            near = chain[-2]
        if not apart[top, near] < threshold:  # a cluster with none near enough is done
            live[top] = False
            apart[:, top] = np.inf
            chain.pop()
        elif len(chain) > 1 and near == chain[-2]:
            keep, gone = sorted((top, near))
            row = (n[keep] * apart[keep] + n[gone] * apart[gone]) / (n[keep] + n[gone])
            apart[keep], apart[:, keep] = row, row
            apart[gone], apart[:, gone] = np.inf, np.inf
            apart[keep, keep] = np.inf
            n[keep] += n[gone]
            live[gone], root[root == gone] = False, keep
            chain = chain[:-2]
        else:
            chain.append(near)
    return root


def added(vectors: np.ndarray, n: np.ndarray, terms: list[np.ndarray], bonus: float) -> Callable:
    """What shared terms, and the bound of one, add to products of vectors, as `paired` takes it; found anew each time by the rows that have a term."""
    # equal vectors can be over one by rounding: they share a thing without a bonus
    _, kind, copies = np.unique(vectors, axis=0, return_inverse=True, return_counts=True)
    bound = np.flatnonzero((copies[kind] > 1) & ((vectors * vectors).sum(1) > 1))
    row = np.concatenate([np.repeat(np.arange(len(terms)), [len(t) for t in terms]), bound])
    _, thing = np.unique(np.concatenate([np.zeros(0, np.int64), *terms]), return_inverse=True)
    thing = np.concatenate([thing, len(thing) + kind[bound]])
    worth = np.where(np.arange(len(row)) < len(row) - len(bound), bonus, 0.0)
    order = np.argsort(thing, kind="stable")
    having, first = row[order], np.searchsorted(thing[order], thing)
    size = np.searchsorted(thing[order], thing, "right") - first
    shared = size > 1
    row, first, size, worth = row[shared], first[shared], size[shared], worth[shared]
    order = np.argsort(row, kind="stable")
    row, first, size, worth = row[order], first[order], size[order], worth[order]
    low, high = np.searchsorted(row, np.arange(len(n))), np.searchsorted(row, np.arange(len(n)), "right")

    def more(clusters: np.ndarray, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        at = np.full(of.max() + 2, -1)
        at[clusters] = np.arange(len(clusters))
        mine = np.flatnonzero((at[of] >= 0) & (high > low))
        work = np.cumsum([size[low[x] : high[x]].sum() for x in mine.tolist()])
        for part in np.split(mine, np.flatnonzero(np.diff(work // PAIRS)) + 1) if len(mine) else ():
            held = np.concatenate([np.arange(low[x], high[x]) for x in part.tolist()])
            ends = np.cumsum(size[held])
            other = having[np.repeat(first[held] - ends + size[held], size[held]) + np.arange(ends[-1])]
            pair, back = np.unique(np.repeat(row[held], size[held]) * len(n) + other, return_inverse=True)
            plus = np.bincount(back, np.repeat(worth[held], size[held]))
            x, y = np.divmod(pair, len(n))
            keep = (of[y] >= 0) & (of[y] != of[x])
            x, y, plus = x[keep], y[keep], plus[keep]
            product = np.einsum("ij,ij->i", vectors[x], vectors[y])
            yield at[of[x]], of[y], (np.minimum(product + plus, 1.0) - product) * n[x] * n[y]

    return more


def _nearest(rows: DataFrame, bonus: float) -> DataFrame:
    """(topic, a, b, apart, root): each cluster's nearest one, a < b, from rows (topic, root, n, vector, terms)."""
    blocks = rows.groupBy("topic").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(blocks, "topic")
    home = dealt.withColumn("block", F.pmod(F.xxhash64("root", F.lit(7)), F.col("blocks")).cast("int")).withColumn("moving", F.lit(0))
    moving = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("moving", F.lit(1))
    columns = ["topic", "block", "moving", "root", "n", "vector", "terms"]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, mine, sums, size = None, None, None, 0  # the block's rows, and the passing cluster with its sums by home cluster

        def nearest() -> pa.RecordBatch | None:
            roots, counts = block["roots"], block["counts"]
            apart = np.round(1 - sums / (size * counts), 12)  # the same from either side
            apart[roots == mine[1]] = np.inf
            best = apart.min()
            if not np.isfinite(best):
                return None
            ties = roots[apart == best]
            tie = symmetric(ties, np.int64(mine[1]))
            other = ties[np.argmin(tie)]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (mine[0], min(mine[1], other), max(mine[1], other), best, tie.min(), mine[1])], ["topic", "a", "b", "apart", "tie", "root"])

        for batch in (whole.slice(k, 256) for whole in batches for k in range(0, len(whole), 256)):
            topic, number, passing, root, n = (batch.column(c).to_numpy().tolist() for c in columns[:5])
            vectors, terms = np.stack(batch.column("vector").to_numpy(zero_copy_only=False)), [np.asarray(t, np.int64) for t in batch.column("terms").to_pylist()]
            low = 0
            while low < len(root):
                high = low + 1
                while high < len(root) and (topic[high], number[high], passing[high], root[high]) == (topic[low], number[low], passing[low], root[low]):
                    high += 1
                if mine is not None and mine != (topic[low], root[low], number[low], passing[low]):
                    if (made := nearest()) is not None:
                        yield made
                    mine = None
                if block is None or block["at"] != (topic[low], number[low]):
                    block = {"at": (topic[low], number[low]), "vectors": [], "terms": [], "n": [], "root": [], "ready": False}
                if not passing[low]:
                    block["vectors"].append(vectors[low:high])
                    block["terms"] += terms[low:high]
                    block["n"] += n[low:high]
                    block["root"] += root[low:high]
                elif block["root"]:
                    if not block["ready"]:
                        at = np.array(block["root"])
                        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                        weight = np.array(block["n"], float)
                        block |= {"ready": True, "stacked": np.concatenate(block["vectors"]), "having": rows_with(block["terms"]), "weight": weight, "starts": starts, "roots": at[starts], "counts": np.add.reduceat(weight, starts)}
                    if mine is None:
                        mine, sums, size = (topic[low], root[low], number[low], 1), np.zeros(len(block["roots"])), 0
                    like = likeness(vectors[low:high], terms[low:high], block["stacked"], block["having"], bonus)
                    own = np.array(n[low:high], float)
                    sums += np.add.reduceat((own @ like) * block["weight"], block["starts"])
                    size += own.sum()
                low = high
        if mine is not None and (made := nearest()) is not None:
            yield made

    met = home.select(*columns).unionByName(moving.select(*columns)).repartition("topic", "block").sortWithinPartitions("topic", "block", "moving", "root")
    found = met.mapInArrow(compared, "topic long, a long, b long, apart double, tie long, root long")
    return found.groupBy("topic", "root").agg(F.min(F.struct("apart", "tie", "a", "b")).alias("p")).select("topic", "p.a", "p.b", "p.apart", "root")


def clusters(rows: DataFrame, threshold: float = 0.6, bonus: float = 0.2) -> DataFrame:
    """(topic, id, cluster) of rows (topic, id, vector of length one, terms: array of strings): average linkage of 1 less their likeness.

    Rows equal in vector and terms are one from the start. Topics of at most TIMES * LOCAL distinct rows (LOCAL, if a vector is longer than one) are clustered in one task,
    larger ones in rounds of mutual nearest clusters; a topic's work grows with the square of its distinct rows. Clusters are numbered by smallest id. Null terms are none.
    """
    terms = F.array_sort(F.array_distinct(F.transform(F.filter(F.coalesce("terms", F.array().cast("array<string>")), lambda t: t.isNotNull()), lambda t: F.xxhash64(t))))
    nodes = rows.select("topic", "id", F.transform("vector", lambda x: x.cast("double")).alias("vector"), terms.alias("terms")).withColumn("node", F.xxhash64("vector", "terms"))
    once = nodes.groupBy("topic", "node").agg(F.count("*").alias("n"), F.any_value("vector").alias("vector"), F.any_value("terms").alias("terms"))
    once = stored(once)
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    sizes = once.groupBy("topic").agg(F.count("*").alias("m"), F.min(F.coalesce(square <= UNIT * UNIT, F.lit(False))).alias("unit"))
    once = once.join(sizes.select("topic", (F.col("m") <= F.when(F.col("unit"), TIMES * LOCAL).otherwise(LOCAL)).alias("small")), "topic")

    def local(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", ignore_index=True)
        weights, ts = group["n"].to_numpy(), [np.asarray(t, np.int64) for t in group["terms"]]
        vectors = np.stack(group["vector"].to_numpy())
        if (vectors * vectors).sum(1).max() <= UNIT * UNIT:
            roots = paired(vectors, weights, threshold, added(vectors, weights, ts, bonus))
        else:
            roots = chained(1 - likeness(vectors, ts, vectors, rows_with(ts), bonus), weights, threshold)
        return pd.DataFrame({"topic": group["topic"], "node": group["node"], "root": group["node"].to_numpy()[roots]})

    small = once.where("small").drop("small")
    labels = by_topic(small).groupBy("topic").applyInPandas(local, "topic long, node long, root long")
    live = stored(once.where("not small").drop("small").withColumn("root", F.col("node")))
    while True:  # each round at least the nearest pair of a topic is merged
        near = stored(_nearest(live, bonus).where(F.col("apart") < threshold))
        pairs = stored(near.groupBy("topic", "a", "b").count().where("count = 2").select("topic", F.col("b").alias("root"), F.col("a").alias("to")))
        if pairs.isEmpty():
            break
        live = stored(live.join(pairs, ["topic", "root"], "left").withColumn("root", F.coalesce("to", "root")).drop("to"))
    labels = stored(labels.unionByName(live.select("topic", "node", "root")))
    rooted = stored(nodes.select("topic", "id", "node").join(labels, ["topic", "node"]).select("topic", "id", "root"))
    number = F.row_number().over(Window.partitionBy("topic").orderBy("least", "root")) - 1  # over a topic's clusters
    numbers = rooted.groupBy("topic", "root").agg(F.min("id").alias("least")).select("topic", "root", number.alias("cluster"))
    return rooted.join(numbers, ["topic", "root"]).select("topic", "id", "cluster")


def described(members: DataFrame, own_words: DataFrame, topic_sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels of clusters, and pairs of clusters of a topic that state one fact.

    members: (topic, cluster, id, source, terms), terms being arrays of strings; own_words (topic, word): words of the topic's own names; topic_sizes (topic, n).
    A term is usable if clusters of at most VAGUE topics have it and not all of its words are the topic's own. A cluster's label is the usable term that most members
    have (support), the smallest among equals, null without one; its core are the members that have it, all without a label. Eligible are clusters whose core has
    FEW_SETS sources or more (one in topics under LARGE_TOPIC). Anchors are other usable terms that half of a core of two or more have.

    First result: (topic, cluster, n, label, support, sources, eligible, anchors). Second: (topic, a, b, why), a < b: half of one's core have the other's label ('label'), or
    exactly these two clusters have an anchor ('anchor').
    """
    each = stored(members.select("topic", "cluster", "id", "source", F.explode(F.array_distinct("terms")).alias("term")).where("term is not null"))
    topics = each.select("topic", "term").distinct()
    vague = topics.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") > VAGUE).select("term")
    word = F.explode(F.split(F.lower("term"), r"[^\p{L}\p{N}]+"))
    other = topics.select("topic", "term", word.alias("word")).where("word <> ''").join(own_words.select("topic", "word").distinct(), ["topic", "word"], "left_anti").select("topic", "term").distinct()
    usable = stored(other.join(vague, "term", "left_anti"))
    told = stored(each.join(usable, ["topic", "term"]))
    counts = told.groupBy("topic", "cluster", "term").agg(F.count("*").alias("support"))
    labels = counts.groupBy("topic", "cluster").agg(F.min(F.struct((-F.col("support")).alias("less"), "term")).alias("best")).select("topic", "cluster", F.col("best.term").alias("label"), (-F.col("best.less")).alias("support"))
    labels = stored(members.groupBy("topic", "cluster").agg(F.count("*").alias("n")).join(labels, ["topic", "cluster"], "left"))
    named = labels.where("label is not null")
    core = each.join(named.select("topic", "cluster", F.col("label").alias("term")), ["topic", "cluster", "term"]).select("topic", "cluster", "id", "source")
    core = stored(core.unionByName(members.join(labels.where("label is null").select("topic", "cluster"), ["topic", "cluster"]).select("topic", "cluster", "id", "source")))
    sizes = stored(core.groupBy("topic", "cluster").agg(F.count("*").alias("size"), F.countDistinct("source").alias("sources")))
    in_core = stored(told.join(core.select("topic", "cluster", "id"), ["topic", "cluster", "id"]))
    shared = in_core.groupBy("topic", "cluster", "term").agg(F.count("*").alias("k")).join(sizes, ["topic", "cluster"])
    anchors = stored(shared.where((F.col("size") >= 2) & (HALF * F.col("k") >= F.col("size"))).join(named.select("topic", "cluster", "label"), ["topic", "cluster"]).where("term <> label").select("topic", "cluster", "term"))
    held = anchors.groupBy("topic", "cluster").agg(F.array_sort(F.collect_list("term")).alias("anchors"))  # at most twice as many as a member has terms
    needed = F.when(F.col("topic_n") >= LARGE_TOPIC, FEW_SETS).otherwise(1)
    first = labels.join(sizes, ["topic", "cluster"]).join(topic_sizes.select("topic", F.col("n").alias("topic_n")), "topic", "left").join(held, ["topic", "cluster"], "left")
    first = first.select("topic", "cluster", "n", "label", "support", "sources", (F.col("sources") >= F.coalesce(needed, F.lit(1))).alias("eligible"), F.coalesce("anchors", F.array().cast("array<string>")).alias("anchors"))

    # labels that members of another core have; a label that many clusters have meets each of them once, through counts
    having = shared.where(HALF * F.col("k") >= F.col("size")).select("topic", F.col("cluster").alias("y"), "term")
    by_label = having.join(named.select("topic", F.col("cluster").alias("x"), F.col("label").alias("term")), ["topic", "term"]).where("x <> y")
    by_label = by_label.select("topic", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit("label").alias("why"))
    twice = anchors.groupBy("topic", "term").agg(F.count("*").alias("users"), F.min("cluster").alias("a"), F.max("cluster").alias("b")).where("users = 2").select("topic", "a", "b", F.lit("anchor").alias("why"))
    return first, by_label.unionByName(twice).groupBy("topic", "a", "b").agg(F.max("why").alias("why"))
