"""Choices within groups: diverse picks of a topic's candidates and average-linkage clusters of all its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.tables import stored

#: Candidates of a topic that are looked at for its picks, and picked, at most: the operator's own bounds.
CANDIDATES, PICKS = 60, 10
#: Clusters of a topic that fit a table of all pairs in a task, and that meet in a block where a topic is dealt over tasks.
LOCAL, BLOCK = 4096, 4096
#: Times LOCAL up to which one task goes on with a topic's clusters by their means; pairs that it looks at together.
TIMES, CELLS = 32, 1 << 22


def best_candidates(rows: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """The candidates (topic, id, impact, vector) of highest impact in each topic."""
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("impact"), "id"))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def greedy(ids: list[int], vectors: np.ndarray, picks: int, most: float) -> list[tuple[int, int | None]]:
    """(id, place or None) in the given order; one nearer than ``most`` to a chosen one is left out."""
    chosen: list[int] = []
    out = []
    for k, i in enumerate(ids):
        ok = len(chosen) < picks and all(float(vectors[k] @ vectors[c]) <= most for c in chosen)
        if ok:
            chosen.append(k)
        out.append((i, len(chosen) if ok else None))
    return out


def diverse_pick(rows: DataFrame, picks: int = PICKS, most: float = 0.5) -> DataFrame:
    """(topic, id, place) of all rows: picks in order of impact; place is null for those too like a better one, beyond the page or not among the candidates."""

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["impact", "id"], ascending=[False, True])
        made = greedy(group["id"].tolist(), np.stack(group["vector"].to_numpy()), picks, most)
        return pd.DataFrame({"topic": group["topic"].iloc[0], "id": [i for i, _ in made], "place": pd.array([p for _, p in made], "Int32")})

    made = stored(best_candidates(rows).groupBy("topic").applyInPandas(pick, "topic long, id long, place int"))
    rest = rows.select("topic", "id").join(made.select("topic", "id"), ["topic", "id"], "left_anti")
    return made.unionByName(rest.withColumn("place", F.lit(None).cast("int")))


def linkage(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Cluster numbers by average linkage of cosine distances, merging while the nearest clusters are nearer than the threshold."""
    n = len(vectors)
    apart = np.clip(1 - vectors @ vectors.T, 0, 2).astype(float)
    np.fill_diagonal(apart, np.inf)
    members = [[i] for i in range(n)]
    live = np.ones(n, bool)
    while live.sum() > 1:
        at = int(np.argmin(apart))
        i, k = sorted(divmod(at, n))
        if not apart[i, k] < threshold:
            break
        a, b = len(members[i]), len(members[k])
        row = (a * apart[i] + b * apart[k]) / (a + b)
        apart[i], apart[:, i] = row, row
        apart[i, i] = np.inf
        apart[k], apart[:, k] = np.inf, np.inf
        members[i] += members[k]
        live[k] = False
    out = np.zeros(n, int)
    for number, i in enumerate(np.flatnonzero(live)):
        out[members[i]] = number
    return out


def symmetric(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair, the same from either side: which of equally near ones is taken, so that many of them pair off at once."""
    x, y = (np.asarray(k).astype(np.int64).view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) for k in (a, b))
    x, y = x ^ (x >> np.uint64(29)), y ^ (y >> np.uint64(29))
    x = (x + y) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def paired(mean: np.ndarray, n: np.ndarray, threshold: float, more: Callable | None = None) -> np.ndarray:
    """The first row of each row's cluster by average linkage, from means of vectors and counts; memory follows the rows.

    The average likeness of two clusters is the product of their means and, if ``more`` is given, what it adds: more(clusters, cluster of each row or -1)
    yields (place among these clusters, other cluster, sum over pairs of rows). All mutual nearest clusters merge at once, which gives the clusters of taking
    the nearest pair first. A cluster's nearest one stays so until one of the two merges, and one with none within the threshold is final.
    """
    mean, n, live = mean.astype(float), n.astype(float), np.arange(len(n))
    root, of = np.arange(len(n)), np.arange(len(n))
    near, best, stale = np.zeros(len(n), int), np.full(len(n), -np.inf), np.ones(len(n), bool)
    while len(n) > 1:
        count, asked = len(n), np.flatnonzero(stale)
        step = max(1, CELLS // count)
        for rows in (asked[k : k + step] for k in range(0, len(asked), step)):
            like = mean[rows] @ mean.T
            for i, k, total in more(rows, of) if more else ():
                np.add.at(like, (i, k), total / (n[rows[i]] * n[k]))
            like[np.arange(len(rows)), rows] = -np.inf
            best[rows] = like.max(1)
            same = like >= best[rows][:, None] - 1e-12
            near[rows] = same.argmax(1)
            for r in np.flatnonzero(np.count_nonzero(same, axis=1) > 1):
                ties = np.flatnonzero(same[r])
                near[rows[r]] = ties[np.argmax(symmetric(live[ties], live[rows[r]]))]
        ok = 1 - best < threshold
        a = np.flatnonzero(ok & (near[near] == np.arange(count)) & (np.arange(count) < near))
        if not len(a):
            if not ok.any():
                break
            top = int(np.argmax(best))
            a, near[near[top]] = np.array([min(top, near[top])]), top
        b = near[a]
        mean[a] = (n[a][:, None] * mean[a] + n[b][:, None] * mean[b]) / (n[a] + n[b])[:, None]
        n[a] += n[b]
        root[live[b]] = live[a]
        into, merged = np.arange(count), np.zeros(count, bool)
        into[b], merged[a], merged[b] = a, True, True
        stale = merged[near] | ~ok[near] | merged
        left = ok.copy()
        left[b] = False
        place = np.where(left, np.cumsum(left) - 1, -1)
        of = np.where(of >= 0, place[into[of]], -1)
        near = place[near][left]
        mean, n, live, best, stale = mean[left], n[left], live[left], best[left], stale[left]
    while (root[root] != root).any():
        root = root[root]
    return root


def by_topic(rows: DataFrame) -> DataFrame:
    """Dealt by topic over tasks enough that few have two large ones, and small ones aren't put together."""
    return rows.repartition(max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "topic")


def _nearest(live: DataFrame) -> DataFrame:
    """(topic, a, b, apart, node): each cluster's nearest, a < b, by blocks of a topic's clusters that all of its clusters pass."""
    blocks = live.groupBy("topic").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = live.join(blocks, "topic").select("topic", "node", F.transform("total", lambda x: x / F.col("n")).alias("mean"), "blocks")
    home = rows.select("topic", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("moving"), "node", "mean")
    moving = rows.select("topic", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("moving"), "node", "mean")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple | None = None
        nodes, means = [], []  # at home in the block
        for batch in (whole.slice(k, 256) for whole in batches for k in range(0, len(whole), 256)):
            topic, block, moving, node = (batch.column(c).to_numpy() for c in ("topic", "block", "moving", "node"))
            mean = np.stack(batch.column("mean").to_numpy(zero_copy_only=False))
            edges = np.r_[0, np.flatnonzero((np.diff(topic) != 0) | (np.diff(block) != 0) | (np.diff(moving) != 0)) + 1, len(topic)]
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if (topic[low], block[low]) != here:
                    here, nodes, means = (topic[low], block[low]), [], []
                if not moving[low]:
                    nodes.append(node[low:high])
                    means.append(mean[low:high])
                    continue
                if not nodes:
                    continue
                nodes, means = [np.concatenate(nodes)], [np.concatenate(means)]
                mine = node[low:high]
                apart = np.round(1 - mean[low:high] @ means[0].T, 12)  # the same from either side
                apart[mine[:, None] == nodes[0]] = np.inf
                best = apart.min(1)
                same = apart == best[:, None]
                other = nodes[0][same.argmax(1)]
                for r in np.flatnonzero(np.count_nonzero(same, axis=1) > 1):
                    ties = nodes[0][same[r]]
                    other[r] = ties[np.argmin(symmetric(ties, mine[r]))]
                ok = np.isfinite(best)
                columns = [topic[low:high], np.minimum(mine, other), np.maximum(mine, other), best, symmetric(mine, other), mine]
                yield pa.RecordBatch.from_arrays([pa.array(c[ok]) for c in columns], ["topic", "a", "b", "apart", "tie", "node"])

    dealt = home.unionByName(moving).repartition("topic", "block").sortWithinPartitions("topic", "block", "moving")
    found = dealt.mapInArrow(compared, "topic long, a long, b long, apart double, tie long, node long")
    return found.groupBy("topic", "node").agg(F.min(F.struct("apart", "tie", "a", "b")).alias("p")).select("topic", "p.a", "p.b", "p.apart", "node")


def _round(live: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The clusters that may still merge, after merging the mutual nearest, and the merged pairs (topic, a, b), b into a."""
    near = stored(_nearest(live).where(F.col("apart") < threshold))
    pairs = stored(near.groupBy("topic", "a", "b").count().where("count = 2").select("topic", "a", "b"))
    side = lambda c: live.select("topic", F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("total").alias(f"t{c}"))
    both = pairs.join(side("a"), ["topic", "a"]).join(side("b"), ["topic", "b"])
    merged = both.select("topic", F.col("a").alias("node"), (F.col("na") + F.col("nb")).alias("n"), F.zip_with("ta", "tb", lambda x, y: x + y).alias("total"))
    ends = pairs.select("topic", F.explode(F.array("a", "b")).alias("node"))
    rest = live.join(near.select("topic", "node"), ["topic", "node"], "left_semi").join(ends, ["topic", "node"], "left_anti")
    return stored(rest.unionByName(merged)), pairs


def clusters(rows: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(topic, id, cluster) of all rows (topic, id, vector of length one): average linkage of cosine distances.

    Equal vectors are one cluster from the start. Topics of more than TIMES * LOCAL clusters merge mutual nearest ones in rounds of
    block-wise comparisons; what is left of a topic after that is clustered within one task. Clusters are numbered by smallest id.
    """
    nodes = rows.select("topic", "id", "vector", F.xxhash64("vector").alias("node"))
    first = nodes.groupBy("topic", "node").agg(F.count("*").alias("n"), F.any_value("vector").alias("vector"))
    live = stored(first.select("topic", "node", "n", F.transform("vector", lambda x: x.cast("double") * F.col("n")).alias("total")))
    labels = stored(live.select("topic", "node", F.col("node").alias("root")))
    relabelled = lambda roots: labels.join(roots.select("topic", F.col("a").alias("to"), F.col("b").alias("root")), ["topic", "root"], "left").select("topic", "node", F.coalesce("to", "root").alias("root"))
    while not (large := stored(live.groupBy("topic").count().where(F.col("count") > TIMES * LOCAL).select("topic"))).isEmpty():
        left, pairs = _round(live.join(large, "topic", "left_semi"), threshold)
        live = stored(live.join(large, "topic", "left_anti").unionByName(left if not pairs.isEmpty() else left.limit(0)))
        labels = stored(relabelled(pairs))

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", ignore_index=True)
        n = group["n"].to_numpy()
        roots = paired(np.stack(group["total"].to_numpy()) / n[:, None], n, threshold)
        return pd.DataFrame({"topic": group["topic"], "a": group["node"].to_numpy()[roots], "b": group["node"]})

    labels = stored(relabelled(by_topic(live).groupBy("topic").applyInPandas(finish, "topic long, a long, b long")))
    rooted = stored(nodes.select("topic", "id", "node").join(labels, ["topic", "node"]).select("topic", "id", "root"))
    number = F.row_number().over(Window.partitionBy("topic").orderBy("least", "root")) - 1  # over a topic's clusters
    numbers = rooted.groupBy("topic", "root").agg(F.min("id").alias("least")).select("topic", "root", number.alias("cluster"))
    return rooted.join(numbers, ["topic", "root"]).select("topic", "id", "cluster")
