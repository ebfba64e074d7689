"""Near-duplicate documents: MinHash bands, odd sketches, and a check on full shingle sets.

1. Each document's distinct word shingles give a digest, MinHash samples, and an odd sketch: each
   sample toggles one bit, so the bits in which two sketches differ count their unequal samples.
   Documents with equal digests form a class; one of them stands for it from there on.
2. Bands of samples put classes into buckets. Classes connected by buckets form a cluster. Bucket
   members are only tied to the bucket's smallest one; no pairs are made of a bucket. Of its ties a
   class keeps one, since the smallest ones it is tied to are tied with each other.
3. A cluster's classes are dealt out in blocks of bounded size. In a task, sketches rule out pairs
   that can't be similar enough, and the rest are checked on their full sets, unless links found
   before already connect them. A second round compares blocks with each other, where a cluster has
   more than one, leaving out pairs of blocks that are one component already.
4. Links leave a task as one tie of each class to the smallest of its component, never as pairs.

Defined results: words are runs of non-white-space after lower-casing A-Z; a text with fewer words
than a shingle has one shingle, all its words; null texts and those without words have no shingles and
link with nothing; rows with a null doc_id are left out; rows that repeat a doc_id count as one
document, the one with most shingles (then the greatest digest); an empty table gives an empty result;
other columns are ignored (one_of_each() keeps them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_words, discard, text_batches, unused, written

WORDS, SIMILARITY = 3, 85
SAMPLES, BITS = 192, 512
#: Most chance that bands miss a pair of just the similarity asked for.
MISS = 3e-7
#: Classes, and their shingles, that a task holds of one block.
BLOCK_SETS, BLOCK_SHINGLES = 384, 400_000

_random = np.random.default_rng(20_240_229)
MULTIPLY = _random.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _random.integers(0, 2**32, SAMPLES, dtype=np.uint32)
MIX = _random.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX[0]
    x = (x ^ (x >> np.uint64(29))) * MIX[1]
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes."""
    distinct, at, lengths = arrow_words(texts)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.as_buffer()) for w in distinct), np.uint64, len(distinct))
    h = mixed(hashes)[at] if len(hashes) else np.zeros(0, np.uint64)
    n = max(0, len(h) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for i in range(words):
        rolled += h[i : i + n] * MIX[2 + i]
    rolled, at = mixed(rolled), 0
    for length in lengths:
        if length >= words:
            yield np.unique(rolled[at : at + length - words + 1])
        elif length:
            yield mixed(np.array([sum(int(x) * int(MIX[8 + i]) for i, x in enumerate(h[at : at + length])) + int(length) & 2**64 - 1], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
        at += length


def samples(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 1024):
        least = np.minimum(least, (MULTIPLY[:, None] * x[None, at : at + 1024] + ADD[:, None]).min(axis=1))
    return least


def band_rows(similarity: int) -> int:
    """The most samples to a band with which SAMPLES samples miss few enough pairs."""
    for rows in range(8, 0, -1):
        if (1 - (similarity / 100) ** rows) ** (SAMPLES // rows) <= MISS:
            return rows
    raise ValueError(f"{SAMPLES} samples are too few for a similarity of {similarity} %")


def band_keys(least: np.ndarray, rows: int) -> np.ndarray:
    bands = SAMPLES // rows
    samples_ = least[: bands * rows].reshape(bands, rows).astype(np.uint64)
    return mixed((samples_ * MIX[2 : 2 + rows]).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * MIX[15]).view(np.int64)


def odd_sketch(least: np.ndarray) -> bytes:
    places = mixed(least.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)
    return np.packbits(np.bincount(places.astype(np.int64), minlength=BITS).astype(np.uint8) & 1).tobytes()


def most_bits(similarity: int) -> float:
    """Differing sketch bits that similar enough sets stay below, but for about one in a million."""
    p = 1 - similarity / 100
    unequal = SAMPLES * p + 4.2 * (SAMPLES * p * (1 - p)) ** 0.5 + 1
    mean = BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * unequal))
    return mean + 2.2 * (BITS / 4 * (1 - (1 - 4 / BITS) ** (2 * unequal))) ** 0.5 + 2


def signatures(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, digest, bands, sketch."""
    rows_of = band_rows(similarity)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 1000):
                some = batch.slice(part, 1000)
                sizes, digests, bands, sketches = [], [], [], []
                for shingles in shingle_sets(some.column(1), words):
                    sizes.append(len(shingles))
                    if len(shingles):
                        least = samples(shingles)
                        digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                        bands.append(band_keys(least, rows_of))
                        sketches.append(odd_sketch(least))
                    else:
                        digests.append(None)
                        bands.append(None)
                        sketches.append(None)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "digest", "bands", "sketch"])

    rows = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull())
    return rows.mapInArrow(sign, "doc_id long, n_shingles long, digest binary, bands array<long>, sketch binary")


def forest(edges: DataFrame) -> DataFrame:
    """edges (a, b) as each task's own union-find leaves them: every node tied to the smallest it knows, a > b."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, at = np.unique(np.concatenate([batch.column(0).to_numpy(), batch.column(1).to_numpy()]), return_inverse=True)
            a, b = at[: batch.num_rows], at[batch.num_rows :]
            low = np.arange(len(nodes))
            while True:
                least = low.copy()
                np.minimum.at(least, a, low[b])
                np.minimum.at(least, b, low[a])
                np.minimum.at(least, low, least.copy())
                least = least[least]
                if (least == low).all():
                    break
                low = least
            tied = low < np.arange(len(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[low[tied]])], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(join, "a long, b long")


def components(ties: DataFrame) -> DataFrame:
    """node, component: the smallest node that ties (a, b) connect it with, for all nodes with a tie.

    Ties shrink to a forest inside each task. Then two steps take turns until every tree is a star: each
    node's larger neighbours move to its smallest one, and so do its smaller ones and itself. Both keep
    the components, never add ties, and about halve the depth of a chain; there is no limit of rounds.
    """
    edges = written(forest(ties).distinct(), "ties")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least"))
        large = both.where("b > a").join(least.select("a", F.least("a", "least").alias("least")), "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        large = written(large, "ties")
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b")).distinct()
        discard(edges)
        edges = written(small, "ties")
        discard(large)
        # Of stars, no centre is tied to a smaller node and no node to two.
        centres = edges.select("b").distinct().withColumnRenamed("b", "a")
        if edges.join(centres, "a", "left_semi").isEmpty() and edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres.select(F.col("a").alias("node"), F.col("a").alias("component")))


def linked(table: pa.Table, similarity: int) -> pa.Table:
    """a, b: ties of the table's classes (node, component, side, sketch, shingles) to the smallest they are linked with."""
    table = table.sort_by("node")
    nodes, sides = table.column("node").to_numpy(), table.column("side").to_numpy()
    two = len(set(sides)) > 1
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    sketches = np.stack([np.frombuffer(x, np.uint64) for x in table.column("sketch").to_pylist()])
    sizes = np.array([len(x) for x in sets], np.int64)
    known, coded = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    marked = np.zeros(len(known), bool)
    _, first, at = np.unique(table.column("component").to_numpy(), return_index=True, return_inverse=True)
    before, limit = first[at], most_bits(similarity)
    roots = before.copy()
    for u in range(len(nodes) - 1):
        v = np.arange(u + 1, len(nodes))
        v = v[roots[v] != roots[u]]
        if two:
            v = v[sides[v] != sides[u]]
        v = v[similarity * np.maximum(sizes[v], sizes[u]) <= 100 * np.minimum(sizes[v], sizes[u])]
        v = v[np.bitwise_count(sketches[v] ^ sketches[u]).sum(axis=1) <= limit]
        if not len(v):
            continue
        own = coded[starts[u] : starts[u + 1]]
        marked[own] = True
        both = np.array([np.count_nonzero(marked[coded[starts[i] : starts[i + 1]]]) for i in v])
        marked[own] = False
        for i in v[100 * both >= similarity * (sizes[u] + sizes[v] - both)]:
            low, high = sorted((roots[u], roots[i]))
            roots[roots == high] = low
    changed = nodes[roots] != nodes[before]
    return pa.table({"a": pa.array(nodes[before][changed], pa.int64()), "b": pa.array(nodes[roots][changed], pa.int64())})


def blocks(members: DataFrame, part: str) -> DataFrame:
    """members (cluster, node, n_shingles, part) with their block of a cluster's part, by hash.

    Parts are counted before shuffling, and a hash deals their classes out, so no task sees a whole
    cluster; blocks are about as large as BLOCK_SETS and BLOCK_SHINGLES say.
    """
    shape = members.groupBy("cluster", part).agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n_shingles") / BLOCK_SHINGLES)).alias("_blocks"))
    return members.join(shape, ["cluster", part]).withColumn("block", F.xxhash64(part, F.pmod(F.xxhash64("node"), F.col("_blocks")))).drop("_blocks")


def grouped(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (whether the document is the smallest of its component)."""
    signed = written(signatures(docs, words, similarity), "signatures")
    once = signed.groupBy("doc_id").agg(F.max(F.struct("n_shingles", "digest")).alias("_best")).select("doc_id", "_best.*")
    members = written(once.withColumn("digest", F.coalesce("digest", F.encode(F.concat(F.lit("empty"), F.col("doc_id")), "utf-8"))), "members")
    classes = written(members.groupBy("digest").agg(F.min("doc_id").alias("node")), "classes")
    # Of a class, one row's bands and sketch go on: it is the only one to be shuffled with them.
    bands = signed.where("n_shingles > 0").join(classes.withColumnRenamed("node", "doc_id"), ["doc_id", "digest"])
    signs = written(bands.select(F.col("doc_id").alias("node"), "n_shingles", "bands", "sketch").dropDuplicates(["node"]), "class-signatures")

    # A bucket ties its members to its smallest; a node keeps one such tie, and its smallest ones are tied among themselves.
    rows = signs.select("node", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = rows.join(shared, "band").groupBy("node").agg(F.array_sort(F.collect_set("first")).alias("firsts"))  # one for each band at most
    firsts = written(firsts.select("node", F.col("firsts")[0].alias("first"), F.expr("slice(firsts, 2, size(firsts))").alias("more")), "bucket-ties")
    leads = components(firsts.select(F.col("first").alias("b"), F.explode("more").alias("a")).distinct()).withColumnRenamed("node", "first")
    clusters = firsts.join(leads, "first", "left").select("node", F.coalesce("component", "first").alias("cluster"))
    near = written(clusters.join(signs, "node").select("node", "cluster", "n_shingles", "sketch"), "clustered")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                some = batch.slice(part, 500)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([x.tobytes() for x in shingle_sets(some.column(1), words)], pa.binary()), some.column(2)], names=["node", "shingles", "_n"])

    # Clustered classes grow with the documents, so the texts are always shuffled to meet them.
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")).join(near.select("node", F.col("n_shingles").alias("_n")).hint("merge"), "node")
    sets = texts.mapInArrow(full, "node long, shingles binary, _n long").where(F.octet_length("shingles") == F.col("_n") * 8).select("node", "shingles").dropDuplicates(["node"])
    sets = written(sets, "shingle-sets")

    pairs_schema = "a long, b long"
    link = lambda table: linked(table, similarity)
    columns = ["node", "component", "side", "sketch", "shingles"]
    first = written(blocks(near.select("cluster", "node", "n_shingles", F.lit(0).alias("part")), "part").select("cluster", "block", "node"), "blocks")
    inner = first.join(near.select("node", "sketch"), "node").join(sets, "node").withColumn("component", F.col("node")).withColumn("side", F.lit(0))
    ties = written(inner.groupBy("cluster", "block").applyInArrow(lambda table: link(table.select(columns)), pairs_schema), "links")

    several = first.groupBy("cluster").agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low < high").select("cluster")
    if several.limit(1).count():
        found = components(ties)
        wide = near.select("cluster", "node", "n_shingles").join(several, "cluster", "left_semi").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        # A component that fills blocks of its own gets them; pairs of these are then left out.
        large = wide.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= BLOCK_SETS // 2).select("cluster", "component", F.lit(True).alias("large"))
        wide = wide.join(large, ["cluster", "component"], "left").withColumn("part", F.when(F.col("large"), F.col("component")).otherwise(-1)).drop("large")
        wide = written(blocks(wide, "part"), "wide-blocks")
        shape = wide.groupBy("cluster", "block").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        left, right = shape.toDF("cluster", "i", "low_i", "high_i"), shape.toDF("cluster", "j", "low_j", "high_j")
        # Pairs of blocks, not of documents; those within one component are left out.
        meet = left.join(right, "cluster").where((F.col("i") <= F.col("j")) & ~((F.col("low_i") == F.col("high_j")) & (F.col("high_i") == F.col("low_j")) & (F.col("low_i") == F.col("high_i"))))
        sides = meet.select("cluster", "i", "j", F.col("i").alias("block"), F.lit(0).alias("side")).unionByName(meet.where("i < j").select("cluster", "i", "j", F.col("j").alias("block"), F.lit(1).alias("side")))
        dealt = wide.join(sides, ["cluster", "block"]).select("cluster", "i", "j", "side", "node", "component").join(near.select("node", "sketch"), "node").join(sets, "node")
        more = dealt.groupBy("cluster", "i", "j").applyInArrow(lambda table: link(table.select(columns)), pairs_schema)
        # A task ties the smallest node that it has of a component; that may be any of the component's.
        ties = written(ties.unionByName(more), "links")

    linked_nodes = components(ties)
    named = members.join(classes, "digest").join(linked_nodes, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    return named.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def one_of_each(docs: DataFrame, words: int, similarity: int) -> DataFrame:
    """The rows of docs that are the kept ones of their components, with all their columns.

    Rows without a doc_id stay; of rows that repeat one, the longest text does (then the greatest).
    """
    keep, kept_id, nth = grouped(docs, words, similarity).where("kept"), unused(docs, "kept_id"), unused(docs, "nth")
    keep = keep.select(F.col("doc_id").alias(kept_id))
    own = docs.where(F.col("doc_id").isNotNull()).join(keep, F.col("doc_id") == F.col(kept_id), "left_semi")
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.char_length("text")), F.desc("text"))
    own = own.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).drop(nth)
    return own.unionByName(docs.where(F.col("doc_id").isNull()))
