"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

The model is log-linear: the log probability of a word after a history adds up the weights of what holds
of both, and a normaliser. Classes factor it. The commonest words and the end sign have classes of their
own; all other words share classes by a hash of their last two characters, and have a share of their
class from counts, with 0.1 added to each and to one unknown word.

* Class features are hashed n-grams and skips with every class: the word before, the classes of the two
  before, the word two before, and the classes of the third and fourth before. All words enter by their
  hash. These weights come from distributed updates: in each round, tasks over a disjoint part of the
  training documents sum observed and expected counts of (feature, class), whose differences are the
  gradient; each weight moves along its own by the log ratio of the two.
* Pair features are (word before, word), by hash: one for each pair seen in training. Spark counts the
  pairs of all training documents in shards. Under an L1 penalty of DISCOUNT the gradient of such a weight is zero where the pair's expected
  count is its count less DISCOUNT; with class features held at what they expect after the word before,
  that has a closed form, from the pairs and their words' counts, which are grouped together.

The normaliser is exact. That of the class features is a sum over the classes. Pair features add, for the
word before, one number for each class: what they add to its words' shares. So no task goes through a
vocabulary, and documents are scored in sparse numpy batches.

Only the class weights (FEATURES x CLASSES numbers), at most PAIRS pair weights, at most VOCABULARY of
the commonest words and what all pairs after these add to each class pass through the driver; they are
broadcast. One shuffle brings the rest: slices of documents ask for the counts of words beyond that
vocabulary, for the other pairs' weights, and after a word beyond it for what its pairs add; another brings
the answers back to their slices. All travel as packed and compressed numbers, many to a row. To be
small, a word of the vocabulary goes by its place there, and others by a hash.

Defined results: a null or empty text has one token, the end; repeated rows are scored alike, each
counting in training; a null doc_id hashes as empty text; without training documents all
probabilities come from the added 0.1 alone; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_words, discard, shuffle_partitions, text_batches, tidied, written

VOCABULARY, OWN, CLASSES, FEATURES, TEMPLATES, ADDED = 65_536, 15, 32, 1 << 14, 4, 0.1
PAIRS, DISCOUNT = 1 << 21, 0.75
#: So many times a word must be seen before the classes after it count for as much as those anywhere.
UNSURE = 10
ROUNDS, BATCH, SMOOTH, BLOCKS = 4, 32_768, 4.0, 64
#: So many tasks' sums of a block are added up before all of the block are.
FAN = 256
#: Tokens, documents, and bytes of documents (but for longer ones, which stand alone) that are scored at a time.
STEP, SLICE, SLICE_BYTES = 8192, 250, 1 << 20
#: Tokens whose class scores fit a processor's cache.
ROWS = 1024
#: How far the weights move along the log ratio in each round; the four templates overlap.
STEPS = (0.45, 0.35, 0.3, 0.25)
#: No weight of a class feature goes beyond this, so that exponentials of their sums stay finite.
LIMIT = 15
#: The end sign as a word; no word holds white space.
END = "\n"
#: Codes of words beyond the vocabulary begin here; others are their places in it, the end sign's 0.
RARE = 1 << 17
END_CODE = 0
#: An odd number: multiples of distinct numbers differ, and lie evenly.
SPREAD = np.uint64(0x9E3779B97F4A7C15)
LOW = np.uint64(2**32 - 1)
SHARED = CLASSES - OWN - 1
_tables: dict[str, dict] = {}


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 == 0


def shared_class(word: Column) -> Column:
    return F.crc32(F.encode(F.substring(word, -2, 2), "utf-8")) % SHARED + OWN + 1


def gathered(batches: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[pa.Array]:
    """The first column of the batches, joined up to about so many bytes; what Arrow holds in reserve goes back after each."""
    held, size = [], 0
    for batch in batches:
        held.append(batch.column(0))
        size += batch.nbytes
        if size >= most:
            yield pa.concat_arrays(held)
            held, size = [], 0
            pa.default_memory_pool().release_unused()
    if held:
        yield pa.concat_arrays(held)


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of at most so many texts and about SLICE_BYTES."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    run, start = (np.cumsum(sizes) - sizes) // SLICE_BYTES, 0
    for end in [*(np.flatnonzero(np.diff(run)) + 1).tolist(), len(sizes)]:
        for at in range(start, end, most):
            yield at, min(most, end - at)
        start = end


def packed(x: np.ndarray) -> bytes:
    """Numbers as compressed bytes, their first bytes together, then their second, and so on."""
    if not len(x):
        return b""
    planes = np.ascontiguousarray(x).view("u1").reshape(-1, x.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(x: bytes, kind: str) -> np.ndarray:
    if not x:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True), "u1")
    return planes.reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Keys in order, their upper halves as steps."""
    high = keys >> np.uint64(32)
    return packed(np.diff(high, prepend=np.uint64(0)) << np.uint64(32) | keys & LOW)


def unpacked_keys(x: bytes) -> np.ndarray:
    keys = unpacked(x, "<u8")
    return np.cumsum(keys >> np.uint64(32), dtype=np.uint64) << np.uint64(32) | keys & LOW


def joined(parts: list[np.ndarray], kind: str) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def numbers(table: pa.Table, name: str, kind: str) -> np.ndarray:
    """The numbers of all rows, one after another."""
    return joined([unpacked(x, kind) for x in table.column(name).to_pylist() if x], kind)


def keys_in(table: pa.Table, name: str) -> np.ndarray:
    return joined([unpacked_keys(x) for x in table.column(name).to_pylist() if x], "<u8")


def dealt(x: np.ndarray, parts: int) -> np.ndarray:
    """Which of so many parts each number belongs to."""
    return ((x.astype(np.uint64) * SPREAD >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def places_of(keys: np.ndarray, parts: int, side: int = 32) -> np.ndarray:
    """The part that each pair belongs to: by the pair if the word before (with side 0, the second) is of the vocabulary, so that a common word's lie in all, else by that word."""
    word = keys >> np.uint64(side) & LOW
    return np.where(word < RARE, dealt(keys, parts), (word % np.uint64(parts)).astype(np.int64))


def by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, its places in order)."""
    order = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else ():
        yield int(part[some[0]]), some


def packed_rows(rows: list[dict], schema: pa.Schema) -> pa.Table:
    """Rows with empty bytes where they say nothing."""
    return pa.table({f.name: pa.array([r.get(f.name, b"") for r in rows], f.type) for f in schema}, schema=schema)


def parts_of(spark) -> int:
    return 2 * shuffle_partitions(spark)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over docs (text); the end sign counts once a document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in gathered(batches):
            words, at, lengths = arrow_words(texts)
            n = np.bincount(at, minlength=len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words.cast(pa.string()), pa.array([END])]), pa.array(np.append(n, len(lengths)))], names=["word", "n"])

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def commonest(counts: DataFrame, most: int) -> list:
    """Rows (word, n) of the commonest words, by falling count: all with at least the least count that at most `most` words have.

    The count is found from how many words have each count, so no task and no driver holds more than
    that; words of equal count are in or out together.
    """
    falling = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    having = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).withColumn("so_far", F.sum("words").over(falling))
    least = having.where(F.col("so_far") <= most).agg(F.min("n")).first()[0]
    rows = counts.where(F.col("n") >= least).collect() if least is not None else []
    return sorted(rows, key=lambda r: (-r["n"], r["word"]))


def prepared(key: str, model: dict) -> dict:
    """The model with lookups, kept for the worker's later tasks."""
    if key not in _tables:
        _tables.clear()
        words = model["words"]
        class_of = np.array([i if i <= OWN else crc32(w[-2:].encode()) % SHARED + OWN + 1 for i, w in enumerate(words)], np.int64)
        index = pa.array(words, pa.large_string())
        _tables[key] = model | {"index": index, "hashes": hashes_of(index), "class_of": class_of, "share": (model["n"] + ADDED) / model["in_class"][class_of]}
    return _tables[key]


def crcs_of(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(crc32, words.cast(pa.large_binary()).to_numpy(zero_copy_only=False)), np.int64, len(words))


def hashes_of(words: pa.Array) -> np.ndarray:
    """Codes of words as if beyond the vocabulary."""
    return crcs_of(words) % (2**32 - RARE) + RARE


def rare_code(word: Column) -> Column:
    """hashes_of() as a Column."""
    return F.crc32(F.encode(word, "utf-8")) % (2**32 - RARE) + RARE


def coded(words: pa.Array, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(vocabulary places or -1, codes) of words."""
    place = pc.fill_null(pc.index_in(words, value_set=model["index"]), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    codes, rare = place.copy(), place < 0
    if rare.any():
        codes[rare] = hashes_of(words.filter(pa.array(rare)))
    return place, codes


def hashed(codes: np.ndarray, model: dict) -> np.ndarray:
    """What features take words by, whatever the vocabulary."""
    hashes = model["hashes"]
    return np.where(codes < RARE, hashes[np.minimum(codes, len(hashes) - 1)], codes) - RARE


def encoded(texts: pa.Array, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(vocabulary places or -1, classes, codes, documents, distinct words, indices into them) of all tokens, ends with index -1."""
    words, at, lengths = arrow_words(texts)
    place, codes = coded(words, model)
    classes = np.empty(len(words), np.int64)
    known = place >= 0
    classes[known] = model["class_of"][place[known]]
    if not known.all():
        ends = pc.utf8_slice_codeunits(words.filter(pa.array(~known)), -2).dictionary_encode()
        classes[~known] = (crcs_of(ends.dictionary) % SHARED + OWN + 1)[np.asarray(ends.indices)]
    indices = np.insert(at, np.cumsum(lengths), -1)
    docs = np.repeat(np.arange(len(lengths)), lengths + 1)
    # The end sign has place and class 0, and stands last, where index -1 finds it.
    every = lambda x, end: np.append(x, end)[indices]
    return every(place, 0), every(classes, 0), every(codes, END_CODE), docs, words, indices


def feature(template: int, key: np.ndarray) -> np.ndarray:
    x = (key.astype(np.uint64) + np.uint64((template + 1) << 40)) * SPREAD
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 14)).astype(np.uint16)


def features(codes: np.ndarray, classes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """A hashed feature of each template for each token: (TEMPLATES, tokens), below FEATURES; codes as hashed() gives them."""

    def before(x: np.ndarray, k: int) -> np.ndarray:
        """x of the k-th token before, counted from 1; 0 before the document's first."""
        out = np.zeros(len(x), np.int64)
        out[k:] = np.where(docs[k:] == docs[:-k], x[:-k] + 1, 0) if len(x) > k else out[k:]
        return out

    keys = (before(codes, 1), before(classes, 1) * 128 + before(classes, 2), before(codes, 2), before(classes, 3) * 128 + before(classes, 4))
    return np.array([feature(i, key) for i, key in enumerate(keys)])


def pair_keys(codes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The code of the word before (the end sign's at a document's start) and of each token, as one number."""
    before = np.full(len(codes), END_CODE, np.int64)
    before[1:] = np.where(docs[1:] == docs[:-1], codes[:-1], END_CODE)
    return before.astype(np.uint64) << np.uint64(32) | codes.astype(np.uint64)


COUNTED = pa.schema([("part", pa.int64()), *((c, pa.binary()) for c in ("keys", "n", "class", "share", "sizes"))])
#: Weighed pairs: those of the driver's keys and what is added after words of the vocabulary, in rows of part -1; by part, the other keys, and what is added after other words, by word and class.
WEIGHED = pa.schema([("part", pa.int64()), *((c, pa.binary()) for c in ("keys", "weights", "cells", "adds", "head_adds", "rest_keys", "rest_weights", "rest_cells", "rest_adds"))])


def schema_text(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>", pa.list_(pa.float64()): "array<double>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def pair_counts(docs: DataFrame, rare: DataFrame, lookups: Broadcast) -> DataFrame:
    """Pairs over docs (text) with their counts, packed, by parts of the words before, and classes and shares of second words beyond the vocabulary.

    rare: w, class, share of words beyond the vocabulary. Tasks count the pairs of some megabytes of text at a
    time. Pairs before a word of the vocabulary are dealt by a hash of the pair, so that a common word's lie
    in all shards; the others are dealt by their word, and meet its share there.
    """
    shards = parts_of(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in gathered(batches, 2_000_000):
            words, at, lengths = arrow_words(texts)
            codes = np.append(coded(words, prepared(*lookups.value))[1], END_CODE)[np.insert(at, np.cumsum(lengths), -1)]
            keys, n = np.unique(pair_keys(codes, np.repeat(np.arange(len(lengths)), lengths + 1)), return_counts=True)
            rows = [{"shard": shard, "keys": packed_keys(keys[some]), "n": packed(n[some].astype("<i8"))} for shard, some in by_part(places_of(keys, shards, 0))]
            yield from packed_rows(rows, pa.schema([("shard", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())])).to_batches()

    def total(table: pa.Table, own: pa.Table) -> pa.Table:
        keys = keys_in(table, "keys")
        if not len(keys):
            return packed_rows([], COUNTED)
        order = np.argsort(keys)
        keys, n = keys[order], numbers(table, "n", "<i8")[order]
        firsts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, n = keys[firsts], np.add.reduceat(n, firsts)
        w, kind, share = (own.column(c).to_numpy() for c in ("w", "class", "share"))
        order = np.argsort(w, kind="stable")
        w, kind, share = w[order], kind[order], share[order]
        low = (keys & LOW).astype(np.int64)
        first = np.searchsorted(w, low)
        times = np.where(low < RARE, 1, np.searchsorted(w, low, "right") - first)  # words of one code
        at = np.repeat(np.arange(len(keys)), times)
        word = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
        rows = []
        for part, some in by_part(dealt(keys >> np.uint64(32), shards)[at]):
            i = at[some]
            k = word[some][low[i] >= RARE]
            rows.append({"part": part, "keys": packed_keys(keys[i]), "n": packed(n[i]), "class": packed(kind[k].astype("u1")), "share": packed(share[k].astype("<f4"))})
        rows[0]["sizes"] = np.bincount(np.floor(np.log2(n)).astype(np.int64), minlength=64).astype("<i8").tobytes()
        return packed_rows(rows, COUNTED)

    rare = rare.withColumn("shard", F.col("w") % shards).groupBy("shard")
    return docs.select("text").mapInArrow(count, "shard long, keys binary, n binary").groupBy("shard").cogroup(rare).applyInArrow(total, schema_text(COUNTED))


def pair_weights(pairs: DataFrame, class_p: np.ndarray, lookups: Broadcast) -> tuple[tuple[Sorted, np.ndarray, np.ndarray, np.ndarray], DataFrame]:
    """((keys times SPREAD in order, their weights; for each word of the vocabulary and class, what these keys and what all pairs add to them), a table with the rest).

    pairs: as pair_counts() returns them. The keys are those after words of the vocabulary, from the least
    power of two on with which at most PAIRS are left. The table has the others' keys and weights, and what
    pairs add after words beyond the vocabulary, as bytes.
    """
    sizes = np.zeros(64, np.int64)
    for r in pairs.where(F.length("sizes") > 0).select("sizes").collect():  # one row for each shard
        sizes += np.frombuffer(r[0], "<i8")
    least = next((x for x in range(64) if sizes[x:].sum() <= PAIRS), 64)
    parts = parts_of(pairs.sparkSession)

    def weigh(table: pa.Table) -> pa.Table:
        """All pairs after some words."""
        pairs_, n, use = keys_in(table, "keys"), numbers(table, "n", "<i8"), prepared(*lookups.value)
        u, w = (pairs_ >> np.uint64(32)).astype(np.int64), (pairs_ & LOW).astype(np.int64)
        kind, share, rare = np.empty(len(w), np.int64), np.empty(len(w)), w >= RARE
        kind[~rare], share[~rare] = use["class_of"][w[~rare]], use["share"][w[~rare]]
        kind[rare], share[rare] = numbers(table, "class", "u1"), numbers(table, "share", "<f4")
        every, at = np.unique(u, return_inverse=True)
        # Words of one code share a pair's weight.
        keys, first, pair = np.unique(pairs_, return_index=True, return_inverse=True)
        own = at[first]
        n_u, cell = np.bincount(own, n[first]), at * CLASSES + kind  # each word but the last sign is before one pair
        # What class features expect after a word: the classes seen there, as far as it is common.
        n_cell, n_seen = np.bincount(cell, n, len(every) * CLASSES), np.bincount(at, n)
        rest = n_u - np.minimum(n_seen, n_u) + UNSURE
        q = share * (n_cell[cell] + rest[at] * class_p[kind]) / (n_u[at] + UNSURE)
        q = np.bincount(pair, q)
        p = (n[first] - DISCOUNT) / n_u[own]
        z = np.maximum(1 - np.bincount(own, q), 1e-6) / np.maximum(1 - np.bincount(own, p), 1e-3)
        weight = np.maximum(np.log(p / q * z[own]), 0).astype("<f4")
        common = every < RARE
        head = (n[first] >= 2.0**least) & common[own]
        gain = share * np.expm1(weight.astype(np.float64))[pair]
        adds, head_adds = np.bincount(cell, gain, len(every) * CLASSES), np.bincount(cell, gain * head[pair], len(every) * CLASSES)
        some, more = weight > 0, np.flatnonzero(adds)
        known = common[more // CLASSES]
        k, m = some & head, more[known]
        cells = every[more // CLASSES].astype(np.uint64) << np.uint64(32) | (more % CLASSES).astype(np.uint64)
        rows = {-1: {"keys": packed_keys(keys[k]), "weights": packed(weight[k]), "cells": packed_keys(cells[known]), "adds": packed(adds[m].astype("<f4")), "head_adds": packed(head_adds[m].astype("<f4"))}}
        k, cells, m = some & ~head, cells[~known], more[~known]
        keys, weight = keys[k], weight[k]
        for part, i in by_part(places_of(keys, parts)):
            rows.setdefault(part, {}).update({"rest_keys": packed_keys(keys[i]), "rest_weights": packed(weight[i])})
        for part, i in by_part(places_of(cells, parts)):
            rows.setdefault(part, {}).update({"rest_cells": packed_keys(cells[i]), "rest_adds": packed(adds[m[i]].astype("<f4"))})
        return packed_rows([r | {"part": part} for part, r in rows.items()], WEIGHED)

    weighed = written(pairs.drop("sizes").groupBy("part").applyInArrow(weigh, schema_text(WEIGHED)), "lm-pair-weights")
    names = ("keys", "weights", "cells", "adds", "head_adds")
    got = pa.table({c: pa.array(x, pa.binary()) for c, x in zip(names, list(zip(*weighed.where("part < 0").select(*names).collect(), strict=True)) or [()] * len(names), strict=True)})  # at most PAIRS pairs, and CLASSES numbers for each word of the vocabulary
    keys, weight, cells, more, own = keys_in(got, "keys"), numbers(got, "weights", "<f4"), keys_in(got, "cells"), numbers(got, "adds", "<f4"), numbers(got, "head_adds", "<f4")
    u, kind = (cells >> np.uint64(32)).astype("<u4"), cells.astype("u1")
    keys = keys * SPREAD
    order, dense = np.argsort(keys), np.zeros((2, len(lookups.value[1]["words"]) + 1, CLASSES), np.float32)  # the last word stands for those beyond the vocabulary
    dense[0, u, kind], dense[1, u, kind] = own, more
    return (Sorted(keys[order], 64), weight[order], *dense), weighed


class Sorted:
    """Places of numbers in a sorted array, by their first bits and a few steps from there."""

    def __init__(self, values: np.ndarray, bits: int):
        self.values = values
        self.shift = values.dtype.type(max(0, bits - max(1, len(values).bit_length() - 1)))
        steps = int(2 ** (bits - int(self.shift)))
        self.starts = np.append(0, np.cumsum(np.bincount((values >> self.shift).astype(np.int64), minlength=steps))).astype(np.int32)

    def __len__(self) -> int:
        return len(self.values)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Each number's place, or -1."""
        first = (x >> self.shift).astype(np.int64)
        at, end = self.starts[first], self.starts[first + 1]
        out, left = np.full(len(x), -1, np.int64), np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            found = self.values[at]
            hit = found == x[left]
            out[left[hit]] = at[hit]
            go = (found < x[left]) & (at + 1 < end)
            left, at, end = left[go], at[go] + 1, end[go]
        return out


def class_shares(feats: np.ndarray, weights: np.ndarray, bias: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The classes' probabilities, a row for each token, and natural logs of those of own, a class for each token."""
    n = feats.shape[1]
    logs, shares, ones = np.empty(n if own is not None else 0, np.float32), np.empty((n, CLASSES), np.float32), np.ones(CLASSES, np.float32)
    added = np.empty((min(n, ROWS), CLASSES), np.float32)
    for at in range(0, n, ROWS):
        first, *others = feats[:, at : at + ROWS]
        z = shares[at : at + ROWS]
        weights.take(first, axis=0, out=z, mode="clip")
        for f in others:
            weights.take(f, axis=0, out=added[: len(f)], mode="clip")
            z += added[: len(f)]
        z += bias
        if own is not None:
            logs[at : at + ROWS] = z[np.arange(len(z)), own[at : at + ROWS]]
        np.exp(z, out=z)  # LIMIT keeps it finite
        total = z @ ones
        z /= total[:, None]
        if own is not None:
            logs[at : at + ROWS] -= np.log(total)
    return shares, logs


def class_logs(feats: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Natural log probabilities of all classes, a row for each token."""
    return np.array([class_shares(feats, weights, bias, np.full(feats.shape[1], c))[1] for c in range(CLASSES)]).T


def statistics(docs: DataFrame, model, weights) -> np.ndarray:
    """Observed and expected counts, (2, FEATURES, CLASSES), summed over docs (text)."""
    wide = FEATURES // BLOCKS

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, expected, seen = np.zeros((2, FEATURES, CLASSES)), np.zeros((CLASSES, FEATURES)), False
        for batch in batches:
            use, now = prepared(*model.value), weights.value
            for at, rows in slices(batch.column(0), 2 * SLICE):
                _, classes, codes, own, _, _ = encoded(batch.column(0).slice(at, rows), use)
                every, seen = features(hashed(codes, use), classes, own), True
                for f in every:
                    sums[0] += np.bincount(f.astype(np.int64) * CLASSES + classes, minlength=FEATURES * CLASSES).reshape(FEATURES, CLASSES)
                for start in range(0, len(codes), BATCH):
                    feats = every[:, start : start + BATCH]
                    p = np.ascontiguousarray(class_shares(feats, now, use["bias"])[0].T, np.float64)
                    for f in feats.astype(np.int64):
                        for c in range(CLASSES):
                            expected[c] += np.bincount(f, p[c], FEATURES)
        sums[1] = expected.T
        if seen:
            for block in range(BLOCKS):
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([TaskContext.get().partitionId() // FAN]), pa.array([sums[:, block * wide : (block + 1) * wide].astype(np.float32).tobytes()])], names=["block", "fan", "sums"])

    def total(table: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in table.column("sums"))
        return pa.table({"block": table.column("block").slice(0, 1), "sums": pa.array([whole.astype(np.float32).tobytes()])})

    # A group holds FAN rows of fixed size, and then one row for each FAN tasks; BLOCKS rows come to the driver.
    parts = docs.select("text").mapInArrow(part, "block long, fan long, sums binary").groupBy("block", "fan").applyInArrow(total, "block long, sums binary")
    with tidied(docs.sparkSession):
        rows = parts.groupBy("block").applyInArrow(total, "block long, sums binary").collect()
    out = np.zeros((2, FEATURES, CLASSES))
    for r in rows:
        out[:, r["block"] * wide : (r["block"] + 1) * wide] = np.frombuffer(r["sums"], np.float32).reshape(2, wide, CLASSES)
    return out


def token_logs(use: dict, weights: tuple, classes: np.ndarray, codes: np.ndarray, docs: np.ndarray, rest: dict | None = None) -> np.ndarray:
    """Natural log probabilities of all tokens, but for the shares of their classes, by the pairs that are broadcast.

    With rest, they are by all pairs but for what it then says is missing: `tokens` whose pairs are not
    broadcast, all those after words beyond the vocabulary among them, with their `keys` and `feats`.
    """
    theta, (keys, boost, head_adds, adds) = weights
    adds = head_adds if rest is None else adds
    feats, pairs = features(hashed(codes, use), classes, docs), pair_keys(codes, docs)
    logs, absent = np.empty(len(codes)), np.empty(len(codes), bool)
    for at in range(0, len(codes), STEP):
        (p, out), own = class_shares(feats[:, at : at + STEP], theta, use["bias"], classes[at : at + STEP]), pairs[at : at + STEP]
        out = out.astype(np.float64)
        found = keys.find(own * SPREAD)
        out[found >= 0] += boost[found[found >= 0]]
        absent[at : at + STEP] = found < 0
        # What pair features add to each class after the word before.
        before = np.minimum(own >> np.uint64(32), np.uint64(len(adds) - 1)).astype(np.int64)
        logs[at : at + STEP] = out - np.log1p(np.einsum("ij,ij->i", p, adds.take(before, axis=0)))
    if rest is not None:
        rest |= {"tokens": np.flatnonzero(absent), "keys": pairs[absent], "feats": feats[:, absent]}
    return logs


@dataclass
class Model:
    rare: DataFrame
    total: int
    distinct: int
    in_class: np.ndarray
    lookups: Broadcast
    weights: Broadcast
    weighed: DataFrame


def fitted(docs: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model of the training documents of docs (doc_id, text)."""
    spark, train = docs.sparkSession, docs.where(~held_out(F.col("doc_id")))
    counts = written(word_counts(train), "word-counts")
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = commonest(counts.where(F.col("word") != END), VOCABULARY)
    ends = counts.where(F.col("word") == END).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words, n_of = [END, *(r["word"] for r in top)], np.array([ends, *(r["n"] for r in top)], np.float64)
    own = words[: OWN + 1]
    shared = {r["k"]: (r["n"], r["v"]) for r in counts.where(~F.col("word").isin(own)).groupBy(shared_class(F.col("word")).alias("k")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}  # CLASSES rows at most
    class_n = np.array([n_of[k] if k < len(own) else shared.get(k, (0, 0))[0] for k in range(CLASSES)], np.float64)
    class_v = np.array([shared.get(k, (0, 0))[1] for k in range(CLASSES)], np.float64)
    bias = np.log((class_n + ADDED) / (class_n.sum() + ADDED * CLASSES)).astype(np.float32)
    # A class of one word shares nothing; the others' words share with one unknown word.
    in_class = np.where(np.arange(CLASSES) < len(own), class_n + ADDED, class_n + ADDED * (class_v + 1))
    lookups = spark.sparkContext.broadcast((uuid.uuid4().hex, {"words": words, "n": n_of, "bias": bias, "in_class": in_class}))

    theta = np.zeros((FEATURES, CLASSES), np.float32)
    part = F.floor(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) / 10) % rounds
    for r in range(rounds if whole["n"] else 0):
        weights = spark.sparkContext.broadcast(theta)
        seen, expected = statistics(train.where(part == r), lookups, weights)
        prior = SMOOTH * np.exp(bias)
        theta = np.clip(theta + STEPS[min(r, len(STEPS) - 1)] * np.log((seen + prior) / (expected + prior)), -LIMIT, LIMIT).astype(np.float32)
        weights.unpersist()

    beyond = counts.where((F.col("word") != END) & (F.col("n") < (top[-1]["n"] if top else 2**62)))
    rare = beyond.select("word", "n", rare_code(F.col("word")).alias("w"), shared_class(F.col("word")).cast("byte").alias("class"))
    in_class_of = F.element_at(F.array(*map(F.lit, in_class.tolist())), F.col("class") + 1)
    shares = rare.select("w", "class", ((F.col("n") + ADDED) / in_class_of).alias("share"))
    counted = written(pair_counts(train, shares, lookups), "lm-pair-counts")
    pairs, weighed = pair_weights(counted, np.exp(bias).astype(np.float64), lookups)
    discard(counted)
    return Model(rare.select("word", "n", "w"), whole["n"], whole["v"], in_class, lookups, spark.sparkContext.broadcast((theta, pairs)), weighed)


#: Of a slice of documents: its own row, with what needs no more than broadcasts; what it asks a part, with documents counted from its first: pairs, those after words beyond the vocabulary with all but the first of their features, and words beyond it, each once, with how often; and a part's answer.
SLICED = pa.schema([("slice", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("doc_id", "n_tokens", "known")), *((c, pa.list_(pa.float64())) for c in ("base", "model"))])
ASKED = pa.schema([*SLICED, ("part", pa.int64()), *((c, pa.binary()) for c in ("keys", "doc", "feats", "words", "times", "word_doc"))])
ANSWERED = pa.schema([*SLICED, *((c, pa.binary()) for c in ("doc", "more", "word_doc", "word_n"))])


def with_nulls(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.table({f.name: pa.array([r.get(f.name) for r in rows], f.type) for f in schema}, schema=schema)


def scores(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fitted(docs, rounds)
    lookups, weights, in_class = model.lookups, model.weights, np.log10(model.in_class)
    all_words = math.log10(model.total + ADDED * (model.distinct + 1))

    parts = parts_of(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, now = prepared(*lookups.value), weights.value
        known_log = np.log10(use["n"] + ADDED)
        for batch in batches:
            for start, n_docs in slices(batch.column("text"), SLICE):
                some = batch.slice(start, n_docs)
                places, classes, codes, docs_of, words, indices = encoded(some.column("text"), use)
                rest: dict = {}
                logs = token_logs(use, now, classes, codes, docs_of, rest)
                rare = places < 0
                own = np.where(rare, 0.0, known_log[places])  # words beyond the vocabulary meet theirs later
                sums = lambda x: np.bincount(docs_of, weights=x, minlength=n_docs)  # noqa: B023, E731
                first = some.column("row")[0].as_py()
                ids, known = some.column("doc_id").to_pylist(), np.bincount(docs_of[~rare], weights=use["n"][places[~rare]] > 0, minlength=n_docs)
                main = {"slice": first, "part": first % parts, "doc_id": ids, "n_tokens": np.bincount(docs_of, minlength=n_docs), "known": known.astype(np.int64), "base": sums(own - all_words), "model": sums(logs / math.log(10) + own - in_class[classes])}
                rows = [main, *asks(docs_of.astype("u1"), codes, rare, words, indices, rest)]
                yield from with_nulls([r | {"slice": first} for r in rows], ASKED).to_batches()

    def asks(docs_of: np.ndarray, codes: np.ndarray, rare: np.ndarray, words: pa.Array, indices: np.ndarray, rest: dict) -> Iterator[dict]:
        """What a slice asks each part."""
        order = np.argsort(rest["keys"])
        keys, own, feats = rest["keys"][order], docs_of[rest["tokens"][order]], rest["feats"][1:, order]
        rows: dict[int, dict] = {}
        for part, i in by_part(places_of(keys, parts)):
            after = i[keys[i] >> np.uint64(32) >= RARE]
            rows.setdefault(part, {}).update({"keys": packed_keys(keys[i]), "doc": packed(own[i]), "feats": packed(feats[:, after].ravel())})
        tokens = np.flatnonzero(rare)
        tokens = tokens[np.argsort(indices[tokens], kind="stable")]
        texts = words.cast(pa.large_binary())
        for part, i in by_part(codes[tokens] % parts):
            each, times = np.unique(indices[tokens[i]], return_counts=True)
            text = b"\n".join(texts.take(pa.array(each)).to_numpy(zero_copy_only=False))
            rows.setdefault(part, {}).update({"words": packed(np.frombuffer(text, "u1")), "times": packed(times.astype("<u4")), "word_doc": packed(docs_of[tokens[i]])})
        return ({"part": part} | r for part, r in rows.items())

    def answer(table: pa.Table, own: pa.Table) -> pa.Table:
        """Slices' own rows, and what a part's pairs add to their documents less what the normaliser takes off after words beyond the vocabulary, and counts of those words."""
        owned = pc.is_valid(table.column("doc_id"))
        mains, table, known = table.filter(owned), table.filter(pc.invert(owned)), own.filter(pc.is_valid(own.column("word")))
        own = own.filter(pc.is_null(own.column("word")))
        columns = {c: table.column(c).to_pylist() for c in ("slice", "keys", "doc", "feats", "words", "times", "word_doc")}
        asked = [unpacked_keys(x or b"") for x in columns["keys"]]
        x = bonus(joined(asked, "<u8"), joined([unpacked(f or b"", "<u2").reshape(TEMPLATES - 1, -1).T for f in columns["feats"]], "<u2").reshape(-1, TEMPLATES - 1), own)
        texts = [unpacked(w or b"", "u1").tobytes() for w in columns["words"]]
        listed = [w for t in texts if t for w in t.split(b"\n")]
        place = pc.index_in(pa.array(listed, pa.binary()), value_set=known.column("word").combine_chunks().cast(pa.binary()))
        seen = np.append(known.column("n").to_numpy(), 0)[pc.fill_null(place, len(known)).to_numpy(zero_copy_only=False)]
        rows, at, word_at = [], 0, 0
        for i, keys in enumerate(asked):
            doc, times = unpacked(columns["doc"][i] or b"", "u1"), unpacked(columns["times"][i] or b"", "<u4")
            sums = np.bincount(doc, x[at : at + len(keys)], 256)
            docs_ = np.flatnonzero(sums)
            rows.append({"slice": columns["slice"][i], "doc": packed(docs_.astype("u1")), "more": packed(sums[docs_].astype("<f4")), "word_doc": columns["word_doc"][i], "word_n": packed(np.repeat(seen[word_at : word_at + len(times)], times).astype("<i8"))})
            at, word_at = at + len(keys), word_at + len(times)
        mains = pa.table({f.name: mains.column(f.name) if f.name in SLICED.names else pa.nulls(len(mains), f.type) for f in ANSWERED}, schema=ANSWERED)
        return pa.concat_tables([with_nulls(rows, ANSWERED), mains])

    def bonus(asked: np.ndarray, feats: np.ndarray, own: pa.Table) -> np.ndarray:
        """What pairs add to the logs of asked tokens."""
        keys, weight, x = keys_in(own, "rest_keys"), numbers(own, "rest_weights", "<f4"), np.zeros(len(asked))
        if len(keys):
            order = np.argsort(keys)
            keys, weight = keys[order], weight[order]
            place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            x = np.where(keys[place] == asked, weight[place], 0).astype(np.float64)
        after = np.flatnonzero(asked >> np.uint64(32) >= RARE)
        cells, adds, u = keys_in(own, "rest_cells"), numbers(own, "rest_adds", "<f4"), asked[after] >> np.uint64(32)
        every, at = np.unique(cells >> np.uint64(32), return_inverse=True)
        if len(every) and len(u):
            dense = np.zeros((len(every), CLASSES), np.float32)
            dense[at, (cells & LOW).astype(np.int64)] = adds
            place = np.minimum(np.searchsorted(every, u), len(every) - 1)
            hit = np.flatnonzero(every[place] == u)
            theta, bias = weights.value[0], prepared(*lookups.value)["bias"]
            for some in np.split(hit, range(STEP, len(hit), STEP)):
                share = class_shares(np.array([feature(0, u[some] - np.uint64(RARE - 1)), *feats[some].T]), theta, bias)[0]
                x[after[some]] -= np.log1p(np.einsum("ij,ij->i", share, dense[place[some]]))
        return x

    def summed(table: pa.Table) -> pa.Table:
        """The documents of a slice, from its own row and all answers."""
        owned = pc.is_valid(table.column("doc_id"))
        main, table = table.filter(owned).to_pylist()[0], table.filter(pc.invert(owned))
        n_docs = len(main["doc_id"])
        doc, more, word_doc, n = (numbers(table, c, k) for c, k in (("doc", "u1"), ("more", "<f4"), ("word_doc", "u1"), ("word_n", "<i8")))
        words = np.bincount(word_doc, np.log10(n + ADDED), n_docs)
        known = np.array(main["known"]) + np.bincount(word_doc[n > 0], minlength=n_docs)
        model_ = np.array(main["model"]) + words + np.bincount(doc, more, n_docs) / math.log(10)
        return pa.table({"doc_id": pa.array(main["doc_id"], pa.int64()), "n_tokens": pa.array(main["n_tokens"], pa.int64()), "n_known": pa.array(known, pa.int64()), "base_score": np.array(main["base"]) + words, "score": model_})

    # Ids of rows rise by one within a task.
    asked = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(score, schema_text(ASKED)).groupBy("part")
    rest = model.weighed.where("part >= 0").select("part", *[c for c in WEIGHED.names if c.startswith("rest")])
    known = rest.unionByName(model.rare.select((F.col("w") % parts).alias("part"), "word", "n"), allowMissingColumns=True).groupBy("part")
    out = asked.cogroup(known).applyInArrow(answer, schema_text(ANSWERED)).groupBy("slice").applyInArrow(summed, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    out = written(out, "scored")
    discard(model.weighed)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
