"""N-gram Jaccard join by parity sketches.

A document is its set of distinct word shingles. Sets A and B of similarity t or more differ in at
most (1 - t) / (1 + t) * (|A| + |B|) elements; for t = 0.8 that is at most a quarter of either.

- *Wide sketch*: each element is XORed, as a 64-bit word, into one block of a sketch whose number of
  blocks depends on a band of set sizes (sets near a band's lower end are sketched for both). A
  differing element changes one block, so at most d = |A| // 4 blocks differ: pigeonhole. Under any
  common order of blocks, the first d + 1 of A and of B share an equal block. The order puts blocks
  that few documents have first, by a fixed-size count of all blocks of all documents, and empty
  blocks last. Documents meet in buckets of equal blocks.
- *Narrow sketch*: one parity bit per hashed element, in 2048 bits or as many as twice the set's size
  needs, by powers of two; halves XORed give the sketch of half the size, so any two sizes compare. The Hamming
  distance is a lower bound of the symmetric difference and rejects most pairs that can't link.
- *Verification*: intersection of the sets.

Only components are wanted, so a bucket need not give all its pairs. Neighbours in order of size and
a leader are paired first; after the linked ones are contracted, members of a bucket that are still
apart are compared by narrow sketch inside tasks, those outside the bucket's largest component
against all, in cells of bounded size. No pair that could link is left out, and none is made within
a component. Equal sets are one node from the start.

Shingles are compared by 64-bit hashes. Nodes are known by 48 bits of a 128-bit digest of their set; sets that share
these 48 bits are found from the digests, and all but one of them get other numbers (about n * n / 2**49 of n sets).

Defined results: no words (null, empty, white space only): an empty set, linked with nothing, its own
component; fewer words than a shingle: the whole sequence is the one shingle; component_id is the
smallest doc_id of the component, null where all are null; repeated rows are members each.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components, relabel
from tessera.llm.tables import narrow, release, small_batches, stored
from tessera.llm.words import SPACE_SPLIT, U64, bytes_of, mix, ngram_hashes, row_slices, split_words

SHINGLE = 5
#: Slots of the count of blocks: 16 a document by powers of two, from the first to the second (64 MB of counts). It only orders blocks.
SLOTS, MOST_SLOTS, CHUNKS = 1 << 20, 1 << 24, 64
#: Tasks whose counts are summed before the last sum.
BRANCH = 64
NARROW_BITS = 2048
#: Bits of a node's id, of a part within a row's bucket (the rest are of the key), and the size up to which sizes are told apart in a bucket's order.
ID_BITS, PART_MASK, MOST_N = 48, (1 << 16) - 1, (1 << 15) - 1
#: Rows of a bucket that are paired with those before them in order of size.
REACH = 3
#: Rows of a bucket, by the count, above which it is dealt over several tasks.
HOT = 4096
CELL = 512
#: Tasks over which the rows of one bucket are dealt when buckets are joined with what is known of them.
SALTS = 16
#: Pairs that are broadcast at most (16 bytes each); more are joined by a shuffle.
BROADCAST_PAIRS = 200_000
#: Rows of one set beyond which the set's component is sent to all tasks: sets of so many rows are few.
HOT_COPIES = 1 << 20
#: Sets that share a number with another one, of which the list is broadcast; not reached below 7 * 10**9 sets.
MOST_RENAMED = 100_000


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offsets = bytes_of(texts)
    for a, b in row_slices(offsets):
        words = split_words(data, offsets[a : b + 1], SPACE_SPLIT)
        grams = ngram_hashes(words.hash, SHINGLE)
        for low, high in zip(words.first.tolist(), words.first[1:].tolist(), strict=False):
            n = high - low
            yield np.unique(grams[low : high - SHINGLE + 1]) if n >= SHINGLE else ngram_hashes(words.hash[low:high], n) if n else grams[:0]


def node(members: np.ndarray) -> tuple[int, int]:
    """128 bits of a digest of the set, as two signed 64-bit integers; the node's id is the last bits of the first unless another set has them."""
    return tuple(np.frombuffer(hashlib.blake2b(members.tobytes(), digest_size=16).digest(), np.int64).tolist())


def node_column(text: Column) -> Column:
    """The first 64 bits of the digest of each text's set; null for an empty set."""

    @F.arrow_udf("long")
    def nodes(texts: pa.Array) -> pa.Array:
        return pa.array([node(s)[0] if len(s) else None for s in shingle_sets(texts)], pa.int64())

    return nodes(text)


def levels(n: int) -> list[int]:
    """Size bands in which a set of n elements is sketched. Sets of fewer than 4 link only with their equals."""
    if n < 4:
        return []
    level = (n.bit_length() - 1) // 2
    return [level, level - 1] if level > 1 and -(-8 * n // 10) < 4**level else [level]


def blocks(members: np.ndarray, level: int) -> np.ndarray:
    """Keys of the non-empty blocks of the wide sketch: 2 * 4**level blocks, by the elements' leading bits."""
    at = members >> U64(63 - 2 * level)
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    content = np.bitwise_xor.reduceat(mix(members + U64(0x632BE59BD9B4E019)), starts)
    return mix(content ^ mix(at[starts] + U64((level + 1) << 48)))


def first_blocks(members: np.ndarray, level: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first |A| // 4 + 1 blocks in the common order, and their counts."""
    keys = blocks(members, level)
    need = len(members) // 4 + 1
    seen = counts[(keys & U64(len(counts) - 1)).astype(np.int64)].astype(np.int64)
    best = np.lexsort((keys, seen))[:need]
    keys, seen = keys[best], seen[best]
    if len(keys) < need:  # empty blocks come last
        empty = np.setdiff1d(np.arange(2 * 4**level, dtype=U64), members >> U64(63 - 2 * level))
        more = np.sort(mix(empty + U64((level + 1) << 48) + U64(1 << 40)))[: need - len(keys)]
        keys, seen = np.r_[keys, more], np.r_[seen, np.full(len(more), 1 << 40)]
    return keys, seen


def narrow_sketch(members: np.ndarray) -> np.ndarray:
    size = max(NARROW_BITS, 1 << (2 * len(members) - 1).bit_length())
    at = mix(members ^ U64(0xA0761D6478BD642F)) & U64(size - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=size) & 1).astype(bool)).view(U64)


def halved(sketch: np.ndarray) -> np.ndarray:
    """Sketch of half as many bits; also of many sketches of one size."""
    half = sketch.shape[-1] // 2
    return sketch[..., :half] ^ sketch[..., half:]


def _packed(counts: np.ndarray) -> bytes:
    """The counts in as few bytes each as the largest needs, deflated; counts beyond 32 bits stay at the largest such number."""
    counts = np.minimum(counts, 0xFFFFFFFF)
    return zlib.compress(counts.astype(next(t for t in (np.uint8, np.uint16, np.uint32) if counts.max() <= np.iinfo(t).max)).tobytes(), 1)


def _unpacked(raw: pa.Buffer | bytes, size: int) -> np.ndarray:
    raw = zlib.decompress(raw)
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(raw) // size]).astype(np.int64)


def _summed(parts: DataFrame, slots: int) -> np.ndarray:
    """Sum of arrays of counts that tasks give in chunks (chunk, branch, counts), first within branches; the result has a fixed size."""
    size = slots // CHUNKS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column("counts"), strict=True):
                total[chunk] = total.get(chunk, 0) + _unpacked(counts.as_buffer(), size)
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([_packed(v) for v in total.values()], pa.binary())], ["chunk", "counts"])

    kind = "chunk int, counts binary"
    out = np.zeros((CHUNKS, size), np.uint32)
    for r in parts.repartition("chunk", "branch").mapInArrow(add, kind).repartition(CHUNKS, "chunk").mapInArrow(add, kind).collect():
        out[r.chunk] = _unpacked(r.counts, size)
    return out.ravel()


def _nodes_and_counts(docs: DataFrame, slots: int, id_bits: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, node, id, rest) of every row, and how many sets have each block, by slots: one pass."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, np.uint32)
        kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary()]
        names = ["doc_id", "n", "node", "rest", "chunk", "counts"]

        def add(keys: list[np.ndarray]) -> None:
            if keys:
                at, n = np.unique(np.concatenate(keys), return_counts=True)
                counts[at] += n.astype(np.uint32)

        for batch in batches:
            rows, keys = [], []
            for s in shingle_sets(batch.column("text")):
                me, rest = node(s) if len(s) else (None, None)
                rows.append((len(s), me, rest))
                keys += [(blocks(s, level) & U64(slots - 1)).astype(np.uint32) for level in levels(len(s))]
                if len(keys) > 500:
                    add(keys)
                    keys = []
            add(keys)
            if rows:
                own = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *own, pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())], names)
        some = [(c, _packed(part)) for c, part in enumerate(counts.reshape(CHUNKS, -1)) if part.any()]
        if some:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(some), k) for k in kinds[:4]), pa.array([c for c, _ in some], pa.int32()), pa.array([p for _, p in some], pa.binary())], names)

    described = docs.mapInArrow(describe, "doc_id long, n long, node long, rest long, chunk int, counts binary")
    both = stored(described.withColumn("branch", F.floor(F.spark_partition_id() / BRANCH)), "nodes")
    return both.where("chunk is null").select("doc_id", "n", "node", F.shiftright(F.shiftleft("node", 64 - id_bits), 64 - id_bits).alias("id"), "rest"), _summed(both.where("chunk is not null").select("chunk", "branch", "counts"), slots)


class Names:
    """Ids of nodes: the last of the digest's first 64 bits, but for the renamed sets."""

    def __init__(self, id_bits: int, renamed: dict[tuple[int, int], int]):
        self.half, self.renamed = 1 << (id_bits - 1), renamed

    def __call__(self, members: np.ndarray) -> int:
        me, rest = node(members)
        me = (me + self.half) % (2 * self.half) - self.half
        return self.renamed.get((me, rest), me) if self.renamed else me


def _named(nodes: DataFrame, id_bits: int) -> tuple[DataFrame, DataFrame, Names]:
    """The nodes with ids that no two sets share, their groups (id, least doc_id), and the ids' rule."""
    groups = stored(nodes.where("id is not null").groupBy("id", "rest").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "groups")
    shared = groups.groupBy("id").agg(F.count("*").alias("m"), F.min("rest").alias("first")).where("m > 1")
    others = groups.join(shared, "id").where("rest <> first").select("id", "rest").limit(MOST_RENAMED + 1).collect()
    if len(others) > MOST_RENAMED:
        raise ValueError(f"more than {MOST_RENAMED} sets share {id_bits} bits of their digests")
    renamed = {(r["id"], r["rest"]): int(mix(np.array([r["rest"]], np.int64).view(U64) ^ U64(r["id"] & 0xFFFFFFFF)).view(np.int64)[0]) >> (64 - ID_BITS) for r in others}
    if renamed:
        new = nodes.sparkSession.createDataFrame([(*k, v) for k, v in renamed.items()], "id long, rest long, new long")
        nodes, groups = (t.join(F.broadcast(new), ["id", "rest"], "left").withColumn("id", F.coalesce("new", "id")).drop("new") for t in (nodes, groups))
    return nodes.drop("rest"), groups.drop("rest"), Names(id_bits, renamed)


def _bucket_rows(docs: DataFrame, counts: np.ndarray, name: Names) -> DataFrame:
    """(bucket, member): the first blocks of each set, packed. Within a task, equal sets give theirs once.

    bucket: 48 bits of the block's key, which is enough to meet by, and the part; parts of a bucket that is dealt count from 1; 0 is a bucket in one part.
    member: n, at most MOST_N, and the id, so that members of a bucket sort by size. Sets beyond MOST_N are compared by it as if they were of one size;
    what then decides has n itself.
    """
    sent = docs.sparkSession.sparkContext.broadcast(counts)
    hot = max(HOT, 4 * int(counts.sum(dtype=np.int64)) // len(counts))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for s in shingle_sets(batch.column(0)):
                for level in levels(len(s)):
                    if level == levels(len(s))[0]:
                        me = name(s)
                        if me in met:
                            break
                        met.add(me)
                    keys, seen = first_blocks(s, level, sent.value)
                    parts = np.where(seen > hot, 1 + me % np.minimum(seen // hot + 1, PART_MASK), 0)
                    rows.append((keys, parts, len(s), me))
                    held += len(keys)
                if held > 200_000:
                    yield _rows(rows)
                    rows, held = [], 0
            if rows:
                yield _rows(rows)

    return docs.select("text").mapInArrow(emit, "bucket long, member long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    times = [len(r[0]) for r in rows]
    buckets = np.concatenate([r[0] for r in rows]) & ~U64(PART_MASK) | np.concatenate([r[1] for r in rows]).astype(U64)
    members = np.repeat(np.array([min(r[2], MOST_N) << ID_BITS | r[3] & (1 << ID_BITS) - 1 for r in rows], np.int64), times)
    return pa.RecordBatch.from_arrays([pa.array(buckets.view(np.int64)), pa.array(members)], ["bucket", "member"])


def _near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From bucket rows in order: pairs (x, y, false) of near neighbours and leaders; and (key, id, true) of rows of large and of dealt buckets."""
    keep = [np.zeros(0, np.int64)] * 2

    def made(bucket: np.ndarray, member: np.ndarray) -> pa.RecordBatch:
        fresh = np.r_[True, (bucket[1:] != bucket[:-1]) | (member[1:] != member[:-1])]
        bucket, member = bucket[fresh], member[fresh]
        n, i = member >> ID_BITS, member << 64 - ID_BITS >> 64 - ID_BITS
        key, part = bucket & ~PART_MASK, bucket & PART_MASK
        begins = np.r_[True, bucket[1:] != bucket[:-1]]
        starts = np.flatnonzero(begins)
        group = np.cumsum(begins) - 1
        sizes = np.diff(np.r_[starts, len(key)])
        left, right = [], []
        for s in range(1, REACH + 1):
            ok = np.flatnonzero((group[s:] == group[:-s]) & (10 * n[:-s] >= 8 * n[s:]))
            left.append(i[ok])
            right.append(i[ok + s])
        # n ascends within a bucket: the leader of a row is the smallest set that may link with it
        place = group * (1 << 32) + n
        lead = np.searchsorted(place, group * (1 << 32) + (8 * n + 9) // 10)
        far = np.flatnonzero(np.arange(len(key)) - lead > REACH)
        left.append(i[lead[far]])
        right.append(i[far])
        x, y = np.concatenate(left), np.concatenate(right)
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
        large = np.flatnonzero((sizes[group] > REACH + 1) | (part != 0)) if len(key) else starts
        return pa.RecordBatch.from_arrays([pa.array(np.r_[pairs[:, 0], key[large]]), pa.array(np.r_[pairs[:, 1], i[large]]), pa.array(np.r_[np.zeros(len(pairs), bool), np.ones(len(large), bool)])], ["x", "y", "large"])

    for batch in batches:
        rows = [np.r_[k, batch.column(c).to_numpy()] for c, k in enumerate(keep)]
        if not len(rows[0]):
            continue
        last = len(rows[0]) - int(np.argmax(rows[0][::-1] != rows[0][-1]))
        if rows[0][0] == rows[0][-1]:
            last = 0  # one bucket so far
        keep = [r[last:] for r in rows]
        if last:
            yield made(*[r[:last] for r in rows])
    if len(keep[0]):
        yield made(*keep)


def _slots(ids: np.ndarray, doc_ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the documents, and of them together with their sets; a null doc_id is 0."""
    docs = mix(doc_ids.fill_null(0).to_numpy(zero_copy_only=False).view(U64) + U64(0x2545F4914F6CDD1D))
    return docs, mix(docs ^ ids.view(U64))


def _pass_filter(ids: DataFrame) -> np.ndarray:
    """Packed bits of the slots of doc_id and of (id, doc_id): those without are certainly absent. Their number follows the count, 32 MB at most."""
    bits = 1 << min(28, max(18, (16 * ids.count()).bit_length()))
    step = 1 << 15

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for slots in _slots(batch.column(0).to_numpy(), batch.column(1)):
                at = np.unique((slots & U64(bits - 1)).astype(np.int64))
                if len(at):
                    starts = np.flatnonzero(np.r_[True, at[1:] >> 3 != at[:-1] >> 3])
                    packed[at[starts] >> 3] |= np.bitwise_or.reduceat((1 << (at & 7)).astype(np.uint8), starts)
        packed = packed.reshape(-1, min(step, bits // 8))
        some = [(c, p.tobytes()) for c, p in enumerate(packed) if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in some], pa.int32()), pa.array([p for _, p in some], pa.binary())], ["chunk", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[chunk] = total.get(chunk, np.uint8(0)) | np.frombuffer(part.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["chunk", "bits"])

    out = np.zeros((-(-bits // 8 // step) or 1, min(step, bits // 8)), np.uint8)
    for r in ids.mapInArrow(mark, "chunk int, bits binary").repartition("chunk").mapInArrow(join, "chunk int, bits binary").collect():
        out[r.chunk] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def _passing(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which slots have their bit set."""
    at = (slots & U64(8 * len(bits) - 1)).astype(np.int64)
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0


def _sets(docs: DataFrame, wanted: DataFrame, name: Names) -> DataFrame:
    """(id, n, sketch, text) of the wanted (id, doc_id), where doc_id is one row that has the set, and of few others.

    Rows that repeat id and text may give a set more than once; links are made distinct in the end.
    """
    passes = docs.sparkSession.sparkContext.broadcast(_pass_filter(wanted))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "n", "sketch", "text"])

        for batch in (whole.slice(k, 1000) for whole in batches for k in range(0, len(whole), 1000)):
            rows: list[tuple] = []
            docs_at, _ = _slots(np.zeros(len(batch), np.int64), batch.column("doc_id"))
            some = batch.take(pa.array(np.flatnonzero(_passing(passes.value, docs_at))))  # only these are split into shingles
            sets = list(shingle_sets(some.column("text")))
            ids = np.array([name(s) if len(s) else 0 for s in sets], np.int64)
            for k in np.flatnonzero(_passing(passes.value, _slots(ids, some.column("doc_id"))[1])).tolist():
                s, i = sets[k], int(ids[k])
                if len(s) >= 4 and i not in met:
                    met.add(i)
                    rows.append((i, len(s), narrow_sketch(s).view(np.int64), some.column("text")[k].as_py()))
                if len(rows) == 1000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

    return stored(docs.mapInArrow(emit, "id long, n long, sketch array<long>, text string"), "sets")


def _side(sets: DataFrame, c: str, what: str) -> DataFrame:
    return sets.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col(what).alias(f"x{c}"))


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the narrow sketch doesn't reject, with the distance of the sketches."""
    both = pairs.join(_side(sets, "a", "sketch"), "a").join(_side(sets, "b", "sketch"), "b")
    words = F.least(F.size("xa"), F.size("xb"))
    # sizes of sets that may link are at most a factor of two apart in bits
    fold = lambda c: F.when(F.size(c) > words, F.transform(F.sequence(F.lit(1), words), lambda k: F.element_at(c, k).bitwiseXOR(F.element_at(c, k + words)))).otherwise(F.col(c))
    apart = F.aggregate(F.zip_with(fold("xa"), fold("xb"), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda n, x: n + x)
    both = both.select("a", "b", "na", "nb", apart.alias("apart"))
    return both.where((100 + percent) * F.col("apart") <= (100 - percent) * (F.col("na") + F.col("nb"))).select("a", "b", "apart")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have that similarity. Texts are moved, as they are smaller than their sets."""
    pairs = pairs.select("a", "b")
    if pairs.count() <= BROADCAST_PAIRS:  # the texts wanted are picked where they lie
        pick = lambda c: sets.select(F.col("id").alias(c), F.col("text").alias(f"x{c}")).join(F.broadcast(pairs), c)
        full = pick("a").join(pick("b"), ["a", "b"])
    else:
        full = pairs.join(_side(sets, "a", "text"), "a").join(_side(sets, "b", "text"), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(shingle_sets(batch.column("xa")), shingle_sets(batch.column("xb")), strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return full.select("a", "b", "xa", "xb").mapInArrow(compare, "a long, b long").distinct()


def _linked(near: DataFrame, sets: DataFrame, percent: int, labels: DataFrame | None) -> DataFrame | None:
    """Labels (id, root) after verifying what of the near pairs joins components.

    Twice only the nearest pair of each component is verified, then all that are left between two
    components: most pairs lie within a component by then and need no sets moved.
    """
    for best in (True, True, False):
        rooted = near.withColumns({"ra": F.col("a"), "rb": F.col("b")})
        if labels is not None:
            root = lambda c: labels.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))  # noqa: E731, B023
            rooted = near.join(root("a"), "a", "left").join(root("b"), "b", "left").withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")})
        near = stored(rooted.where("ra <> rb").select("a", "b", "apart", "ra", "rb"), "near")
        if near.isEmpty():
            return labels
        tried = near
        if best:
            pair = F.min(F.struct("apart", "a", "b", "ra", "rb")).alias("p")
            tried = near.unionByName(near.withColumn("ra", F.col("rb"))).groupBy("ra").agg(pair).select("p.a", "p.b").distinct()
        links = stored(_verified(tried, sets, percent), "links")
        near = near.select("a", "b", "apart")
        release(sets.sparkSession)
        ends = links
        if labels is not None:
            ends = links.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        roots = components(ends)
        labels = roots if labels is None else stored(relabel(labels, roots), "labels")
    return labels


def _across(large: DataFrame, sets: DataFrame, labels: DataFrame | None, per_root: int | None) -> DataFrame:
    """Pairs (a, b) from large buckets (key, id) whose ends are in different components and pass the narrow sketch.

    With per_root, only the nearest so many in a cell for each row and other component; a bucket from which pairs were
    left out so is named in a row of its own, (key, null).
    """
    if labels is None:
        rows = large.withColumn("root", F.col("id"))
    else:
        rows = large.join(labels, "id", "left")
    # one bucket may have very many rows: they meet what is known of it in SALTS tasks
    rows = rows.select("key", "id", F.coalesce("root", "id").alias("root"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    by_root = rows.groupBy("key", "root").agg(F.count("*").alias("m"))
    torn = by_root.groupBy("key").agg(F.sum("m").alias("size"), F.count("*").alias("roots"), F.max_by("root", F.struct("m", "root")).alias("main")).where("roots > 1")
    cells = F.ceil(F.col("size") / CELL).cast("int")
    torn = torn.withColumn("salt", F.explode(F.array(*[F.lit(k).cast("long") for k in range(SALTS)])))
    rows = rows.join(torn, ["key", "salt"]).join(sets.select("id", "n", "sketch"), "id")
    rows = rows.select("key", "id", "n", "root", "sketch", (F.col("root") == F.col("main")).alias("main"), cells.alias("cells"), F.pmod(F.xxhash64("id"), cells).cast("int").alias("home"))
    home = rows.select("key", F.col("home").alias("cell"), F.lit(0).alias("moving"), "id", "n", "root", "sketch")
    moving = rows.where("not main").select("key", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.lit(1).alias("moving"), "id", "n", "root", "sketch")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple | None = None
        held: dict[int, list] = {}  # rows at home in the cell, by size of the sketch
        for batch in batches:
            key, cell, moving, *rest = (batch.column(c).to_numpy() for c in ("key", "cell", "moving", "id", "n", "root"))
            sketches = batch.column("sketch")
            places, bits = sketches.offsets.to_numpy(), sketches.values.to_numpy().view(U64)  # signed values would count bits of their absolute
            width = np.diff(places)
            change = (np.diff(key) != 0) | (np.diff(cell) != 0) | (np.diff(moving) != 0) | (np.diff(width) != 0)
            edges = np.r_[0, np.flatnonzero(change) + 1, len(key)]
            found, left_out = [], []
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if high == low:
                    continue
                if (key[low], cell[low]) != here:
                    here, held = (key[low], cell[low]), {}
                rows = [*(c[low:high] for c in rest), bits[places[low] : places[high]].reshape(high - low, width[low])]
                if moving[low]:
                    cut: list[bool] = []
                    found += [p for size, home in held.items() if size in (width[low] // 2, width[low], width[low] * 2) for p in _near_in_cell(rows, home, per_root, cut)]
                    if any(cut):
                        left_out.append(int(key[low]))
                else:
                    size = int(width[low])
                    held[size] = [np.concatenate(x) for x in zip(held[size], rows, strict=True)] if size in held else rows
            if found:
                pairs = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
            if left_out:
                keys = sorted(set(left_out))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.nulls(len(keys), pa.int64())], ["a", "b"])

    parts = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much to compute: not to be coalesced
    dealt = home.unionByName(moving).repartition(parts, "key", "cell").sortWithinPartitions("key", "cell", "moving", F.size("sketch"))
    return dealt.mapInArrow(compared, "a long, b long").distinct()


def _near_in_cell(rows: list, home: list, per_root: int | None, cut: list[bool]) -> Iterator[np.ndarray]:
    """Pairs of rows with home rows of another root, of sizes that may link and sketches near enough, as (smaller id, larger id)."""
    step = max(1, (1 << 20) // (len(home[0]) * home[3].shape[1]))
    for at in range(0, len(rows[0]), step):
        ids, sizes, roots, sketches = (x[at : at + step] for x in rows)
        their_ids, their_sizes, their_roots, theirs = home
        if theirs.shape[1] > sketches.shape[1]:
            theirs = halved(theirs)
        elif theirs.shape[1] < sketches.shape[1]:
            sketches = halved(sketches)
        n, m = sizes[:, None], their_sizes[None, :]
        r, c = np.nonzero((roots[:, None] != their_roots) & (10 * np.minimum(n, m) >= 8 * np.maximum(n, m)))
        apart = np.bitwise_count(sketches[r] ^ theirs[c]).sum(1, dtype=np.int64)
        near = 9 * apart <= sizes[r] + their_sizes[c]
        r, c, apart = r[near], c[near], apart[near]
        if per_root is not None and len(r):
            order = np.lexsort((apart, their_roots[c], r))
            r, c = r[order], c[order]
            begins = np.r_[True, (r[1:] != r[:-1]) | (their_roots[c][1:] != their_roots[c][:-1])]
            rank = np.arange(len(r)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
            cut.append(bool((rank >= per_root).any()))
            r, c = r[rank < per_root], c[rank < per_root]
        if len(r):
            yield np.stack([np.minimum(ids[r], their_ids[c]), np.maximum(ids[r], their_ids[c])], 1)


def _distinct_buckets(large: DataFrame) -> DataFrame:
    """One bucket of those with the same members: a passage that documents share makes many buckets of just these.

    Members are told by two sums of hashes of their ids and their number.
    """
    members = large.distinct()
    sign = [F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x"), F.count("*").alias("m")]
    kept = members.groupBy("key").agg(*sign).groupBy("s", "x", "m").agg(F.min("key").alias("key")).select("key")
    return stored(members.join(kept, "key", "left_semi"), "large")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, id_bits: int = ID_BITS) -> DataFrame:
    """(doc_id, n_shingles, component_id, component, node) of every row; component is a node's id, node 64 bits of the digest of the row's
    set (``node_column``), both null for an empty set.

    ``percent`` may be 80 or more: the numbers of blocks are made for differences of at most a quarter. Fewer
    ``id_bits`` (ID_BITS at most) give the same result through more sets of shared numbers.
    """
    if percent < 80:
        raise ValueError("the wide sketch is laid out for a similarity of 0.8 or more")
    small_batches(docs.sparkSession)
    docs = narrow(docs, id_col, text_col)
    slots = min(MOST_SLOTS, max(SLOTS, 1 << (16 * docs.count()).bit_length()))
    nodes, counts = _nodes_and_counts(docs, slots, id_bits)
    nodes, groups, name = _named(nodes, id_bits)
    texts = docs.where("text is not null")
    rows = _bucket_rows(texts, counts, name).repartition("bucket").sortWithinPartitions("bucket", "member")
    met = stored(rows.mapInArrow(_near_pairs, "x long, y long, large boolean"), "met")
    release(docs.sparkSession)
    pairs = stored(met.where("not large").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "pairs")
    large = _distinct_buckets(met.where("large").select(F.col("x").alias("key"), F.col("y").alias("id")))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(large.select("id")).distinct()
    sets = _sets(texts, wanted.join(groups, "id"), name)
    labels = _linked(_near(pairs, sets, percent), sets, percent, None)
    first = stored(_across(large, sets, labels, 4), "across")
    labels = _linked(_near(first.where("b is not null"), sets, percent), sets, percent, labels)
    left_out = first.where("b is null").select(F.col("a").alias("key"))
    if not left_out.isEmpty():
        rest = large.join(left_out, "key", "left_semi")
        labels = _linked(_near(_across(rest, sets, labels, None), sets, percent), sets, percent, labels)
    if labels is None:
        labels = groups.select("id", F.col("id").alias("root")).limit(0)
    groups = groups.join(labels, "id", "left").select("id", "least", "copies", F.coalesce("root", "id").alias("component"))
    top = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(groups.join(top, "component").select("id", "copies", "component", "component_id"), "named")
    some = ["doc_id", "n", "node", "component", "component_id"]
    hot, sets_of_few = F.broadcast(named.where(F.col("copies") > HOT_COPIES)), named.where(F.col("copies") <= HOT_COPIES)
    full = nodes.where("id is not null")
    out = full.join(hot, "id").select(some).unionByName(full.join(hot.select("id"), "id", "left_anti").join(sets_of_few, "id").select(some))
    out = out.unionByName(nodes.where("id is null").select("doc_id", "n", "node", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "component", "node")
