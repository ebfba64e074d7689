"""Packing of tokenised documents into sequences: shortest pack first over the length histogram.

A document's token ids, ended by an end id, are cut into pieces of the sequence length and one
remainder. Only the histogram of piece lengths (at most one count for each length up to the sequence
length) goes to the driver. There, lengths are placed longest first, each into the packs that are
shortest so far, by counts of packing patterns rather than by document. Shorter pieces then find their
place by their rank among the pieces of their length: ranks come from counts of salted groups, more of
them the more pieces there are, so that no task has to hold all pieces of a common length. Full pieces
need no rank and no shuffle: each is a sequence of its own.

Defined results: a null text counts as empty (it has the end id only); an empty table gives an empty
result; repeated rows are packed as often as they occur; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_batches, written

SEQUENCE, END_ID = 2048, 1
#: Salted groups of each length: at least so many, and one for so many pieces.
SALTS, SALTED = 64, 50_000_000
SPECIAL = "<|endoftext|>"

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of byte-level BPE: by the ranks of the vocabulary, or where a text holds the special token by the tokenizers library."""

    def __init__(self, vocabulary: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.vocabulary, self.whole = vocabulary, None

    def special(self, text: str) -> bytes:
        if self.whole is None:
            import public_tokenizers
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(public_tokenizers.path(f"{self.vocabulary}.json"))
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if SPECIAL in text:
            return self.special(text)
        return self.plain.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k", length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit ids), doc_tokens: each document's ids and end id in pieces of at most length.

    task and nth number the full pieces as each task makes them.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, step = encoder(vocabulary), 4 * length
        end, task, full = np.asarray([end_id], dtype="<u4").tobytes(), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                some = batch.slice(part, 500)
                doc_ids, starts, lengths, ids, totals, nth = [], [], [], [], [], []
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    whole = enc.ids(text or "") + end
                    for at in range(0, len(whole), step):
                        blob = whole[at : at + step]
                        doc_ids.append(doc_id)
                        starts.append(at // 4)
                        lengths.append(len(blob) // 4)
                        ids.append(blob)
                        totals.append(len(whole) // 4)
                        nth.append(full if len(blob) == step else None)
                        full += len(blob) == step
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary()), pa.array(totals, pa.int64()), pa.array([task] * len(nth), pa.int32()), pa.array(nth, pa.int64())], names=["doc_id", "start", "length", "ids", "doc_tokens", "task", "nth"])

    return text_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, task int, nth long")


def patterns(histogram: dict[int, int], length: int = SEQUENCE) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths longest first) of packs holding each of the histogram's pieces once.

    Lengths go in longest first, each into the shortest packs with room, else into new ones.
    """
    by_total: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for size in sorted(histogram, reverse=True):
        left, added = histogram[size], []
        for total in sorted(t for t in by_total if t + size <= length):
            while left and by_total[total]:
                count, pack = by_total[total].pop()
                times = min((length - total) // size, max(1, -(-left // count)))  # as many to each pack as fit and are needed
                full = min(count, left // times)
                rest = left - full * times if full < count else 0
                if full:
                    added.append((full, pack + (size,) * times))
                if rest:
                    added.append((1, pack + (size,) * rest))
                if count - full - bool(rest):
                    by_total[total].append((count - full - bool(rest), pack))
                left -= full * times + rest
            if not left:
                break
        if left:
            times = length // size
            full, rest = divmod(left, times)
            added += [(full, (size,) * times)] * bool(full) + [(1, (size,) * rest)] * bool(rest)
        for count, pack in added:
            by_total.setdefault(sum(pack), []).append((count, pack))
    return [x for total in sorted(by_total) for x in by_total[total]]


def slots(packs: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces in each sequence, offset) for runs of ranks within each length."""
    rows, taken, sequence = [], {}, 0
    for count, pack in packs:
        at = 0
        for size in sorted(set(pack), reverse=True):
            times, first = pack.count(size), taken.get(size, 0)
            rows.append((size, first, first + count * times, sequence, times, at))
            taken[size] = first + count * times
            at += size * times
        sequence += count
    return rows


def pack(parts: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """parts (as of pieces(), with any more columns) with sequence_id and offset.

    parts is read more than once, so hand over a written table. Sequences are gapless from offset 0;
    those of full pieces have ids above all others.
    """
    spark, names = parts.sparkSession, [c for c in parts.columns if c not in ("task", "nth")]
    short = parts.select(F.struct(*names).alias("_row"), "length", "doc_id", "start").where(F.col("length") < length)
    histogram = {r["length"]: r["n"] for r in short.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # fewer than `length` rows
    packs = patterns(histogram, length)
    places = spark.createDataFrame(slots(packs), "_length long, _from long, _to long, _sequence long, _times long, _at long")
    short = short.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(max(SALTS, sum(histogram.values()) // SALTED))).cast("int"))
    counts = short.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "piece-counts")
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "start")
    # Pieces and counts lie by length and salt, so that Spark needs no other shuffle to join them, and broadcasts counts only while they are small.
    ranked = short.withColumn("_in", F.row_number().over(within) - 1).join(counts, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_in"))
    # Patterns come from a histogram of fewer than `length` bins, so their number is bounded, whatever the number of pieces.
    placed = ranked.join(F.broadcast(places), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    nth = F.col("_rank") - F.col("_from")
    placed = placed.select("_row.*", (F.col("_sequence") + F.floor(nth / F.col("_times"))).alias("sequence_id"), (F.col("_at") + F.pmod(nth, F.col("_times")) * F.col("length")).alias("offset"))
    shared = sum(count for count, _ in packs)
    full = parts.where(F.col("length") == length)
    tasks = full.groupBy("task").agg(F.count(F.lit(1)).alias("_n"))
    first = F.coalesce(F.sum("_n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = tasks.select("task", (first + F.lit(shared)).alias("_first"))  # one row for each task that made pieces
    full = full.join(F.broadcast(tasks), "task").select(*names, (F.col("_first") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)


def packed_digests(docs: DataFrame) -> DataFrame:
    """The packing of docs with a checksum in place of each piece's ids."""
    digests = pieces(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "task", "nth")
    return pack(written(digests, "pieces"))


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset: the packed sequences' pieces with their token ids."""
    return pack(written(pieces(docs), "pieces"))
