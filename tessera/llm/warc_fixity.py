"""Merkle fixity audit of WARC records held by two replicas.

A record is serialised as a WARC/1.1 response; records of a file lie one behind the other, in order,
which gives each an offset range. A record's leaf hash covers its slot, length and digest. Tree nodes hash
their children with the offset ranges that these take within the node, in order, FANOUT children a node: the root of a
file stands for all its records and their offsets, and a record of another length changes the nodes above it and no
other. An audit compares the roots of both replicas per file and goes down only where nodes differ, level by
level; below an equal node nothing is read again.

Both trees are stored level by level in the shared folder. A file holds RECORDS_PER_FILE consecutive
record numbers, one record each. Records without a number, and all but one (the least digest) of those that
repeat a number with other contents, are dealt by their digests over 2**40 numbers below all others, so that no file,
window or node grows with them.

Defined results: a null url or html counts as empty and as different from nothing else; a record that one replica
lacks is 'missing' or 'extra'; equal records count as one with a number of copies; records without a number of their own
are known by their content, so that an altered one is missing and extra; their file is the dealt one;
empty tables have no roots and no findings; extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.tables import stored

FANOUT = 16
RECORDS_PER_FILE = 4096
#: Records of one number with other contents beyond which the number is sent to all tasks.
HOT_NUMBER = 1 << 20
#: Numbers below this one are dealt to records without a number of their own.
DEALT = -(1 << 42)


def record_bytes(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC/1.1 response record as text: header with length, blank line, payload, two line ends."""
    payload = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, payload, F.lit("\r\n\r\n"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(file, place, slot, page_id, length, digest, copies): place is the number in its file; slot also tells those without their own."""
    page = F.col(f"`{id_col}`").cast("long")
    whole = record_bytes(page, F.col(f"`{url_col}`").cast("string"), F.col(f"`{html_col}`").cast("string"))
    rows = pages.select(page.alias("page_id"), F.octet_length(whole).cast("long").alias("length"), F.sha2(whole, 256).alias("digest"))
    rows = rows.groupBy("page_id", "length", "digest").agg(F.count("*").alias("copies"))
    numbered = rows.where("page_id is not null")
    repeated = numbered.groupBy("page_id").agg(F.count("*").alias("m"), F.min("digest").alias("least")).where("m > 1")
    # numbers of very many records are few and go to all tasks; those without a number meet nothing
    hot = F.broadcast(repeated.where(F.col("m") > HOT_NUMBER).select("page_id", "least"))
    often = numbered.join(hot, "page_id")
    seldom = numbered.join(hot.select("page_id"), "page_id", "left_anti").join(repeated.where(F.col("m") <= HOT_NUMBER).select("page_id", "least"), "page_id", "left")
    rows = often.unionByName(seldom).unionByName(rows.where("page_id is null").withColumn("least", F.lit(None).cast("string")))
    own = F.col("page_id").isNotNull() & F.coalesce(F.col("digest") == F.col("least"), F.lit(True))
    number = F.when(own, F.col("page_id")).otherwise(F.lit(DEALT) - F.pmod(F.xxhash64("digest"), F.lit(1 << 40)))
    place = F.pmod(number, F.lit(RECORDS_PER_FILE))
    slot = F.concat_ws(":", F.lpad(place.cast("string"), 4, "0"), F.when(~own, F.col("digest")))
    return rows.select(F.floor(number / RECORDS_PER_FILE).cast("long").alias("file"), place.alias("place"), slot.alias("slot"), "page_id", "length", "digest", "copies")


def leaves(recs: DataFrame) -> DataFrame:
    """Records with their leaf hash and the bytes that they take."""
    return recs.withColumns({"size": F.col("length") * F.col("copies"), "hash": F.sha2(F.concat_ws("|", "slot", "length", "copies", "digest"), 256)})


def offsets(recs: DataFrame) -> DataFrame:
    """Records with their offset in the file."""
    before = Window.partitionBy("file").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return recs.withColumn("offset", F.coalesce(F.sum(F.col("length") * F.col("copies")).over(before), F.lit(0)).cast("long"))


def tree(recs: DataFrame) -> DataFrame:
    """All nodes (file, level, node, hash, size in bytes); level 0 are groups of leaves by slot, the last level is the root.

    A node's number is the place in the file divided by FANOUT for each level, so both replicas have
    the same tree whatever they lack. A child is hashed with its offset range in the node.
    """
    level = leaves(recs).select("file", F.lit(0).alias("level"), F.floor(F.col("place") / FANOUT).cast("long").alias("node"), F.col("slot").alias("place"), "hash", "size")
    span, levels = FANOUT, []
    begin = lambda k: F.aggregate(F.slice("children", F.lit(1), k), F.lit(0).cast("long"), lambda n, c: n + c["size"])
    while True:
        gathered = level.groupBy("file", "level", "node").agg(F.array_sort(F.collect_list(F.struct("place", "hash", "size"))).alias("children"), F.sum("size").alias("size"))
        ranges = F.transform("children", lambda c, k: F.concat_ws(":", c["place"].cast("string"), begin(k).cast("string"), (begin(k) + c["size"]).cast("string"), c["hash"]))
        nodes = stored(gathered.select("file", "level", "node", F.sha2(F.array_join(ranges, ","), 256).alias("hash"), "size"), "tree")
        levels.append(nodes)
        if span >= RECORDS_PER_FILE:
            break
        span *= FANOUT
        level = nodes.select("file", (F.col("level") + 1).alias("level"), F.floor(F.col("node") / FANOUT).cast("long").alias("node"), F.col("node").alias("place"), "hash", "size")
    out = levels[0]
    for nodes in levels[1:]:
        out = out.unionByName(nodes)
    return out


def audit(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """Damaged records: (file, page_id, offset, length, digest, found_digest, finding), offsets as in ``pages``.

    finding is 'altered', 'missing' (from the replica) or 'extra'; for extra ones offset, length and digest are null.
    """
    ours, theirs = stored(records(pages), "records"), stored(records(replica), "records")
    a, b = tree(ours), tree(theirs)
    top = 0
    span = FANOUT
    while span < RECORDS_PER_FILE:
        span, top = span * FANOUT, top + 1

    def differing(level: int, parents: DataFrame | None) -> DataFrame:
        x, y = (t.where(F.col("level") == level).select("file", "node", F.col("hash").alias(h)) for t, h in ((a, "x"), (b, "y")))
        if parents is not None:
            under = parents.select("file", F.col("node").alias("parent"))
            x, y = (t.withColumn("parent", F.floor(F.col("node") / FANOUT).cast("long")).join(under, ["file", "parent"], "left_semi").drop("parent") for t in (x, y))
        return stored(x.join(y, ["file", "node"], "full").where("not (x <=> y)").select("file", "node"), "differing")

    at = None
    for level in range(top, -1, -1):
        at = differing(level, at)
    node = F.floor(F.col("place") / FANOUT).cast("long")
    # offsets need a whole file, so only files with a difference are placed
    left = offsets(ours.join(at.select("file").distinct(), "file", "left_semi")).withColumn("node", node).join(at, ["file", "node"], "left_semi")
    right = theirs.withColumn("node", node).join(at, ["file", "node"], "left_semi")
    x = left.select("file", "slot", "page_id", "offset", "length", "digest", F.col("copies").alias("n"))
    y = right.select("file", "slot", F.col("page_id").alias("their_id"), F.col("digest").alias("found_digest"), F.col("copies").alias("m"))
    both = x.join(y, ["file", "slot"], "full").where("not (digest <=> found_digest) or not (n <=> m)")
    finding = F.when(F.col("m").isNull(), "missing").when(F.col("n").isNull(), "extra").otherwise("altered")
    return both.select("file", F.coalesce("page_id", "their_id").alias("page_id"), "offset", "length", "digest", "found_digest", finding.alias("finding"))
