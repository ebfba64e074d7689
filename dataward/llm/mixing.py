"""Mixing of sources to target weights by entropy balancing.

Each source has a target number of words. Of all document rates between 0 and `most` whose expected
words meet the target, the balanced ones stay closest to taking every document once in relative
entropy: rate = min(most, exp(lambda * size / mean size)), with one lambda for each source. The dual
in lambda is convex; Newton steps, kept within a bracket, solve it for all sources at once, each step
one Spark aggregation over the counts of documents by source and size. Rates then become copies:
documents of a source are rounded class by class, largest sizes first, carrying the words still due
along, so a source ends within about one of its smallest documents of its target.

Rates depend on a document's source and size only, so all the work is done on counts by (source,
size). Sizes that a source has are bounded by its longest document; the documents themselves only meet
their class's number of copies, by a rank from salted counts.

Defined results: a null text has size 0 and none of its words are taken; a null source is a source of
its own, last in order; repeated rows count as documents of their own; a target of three times a
source's size takes each document three times; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

MOST, STEPS, WEIGHTS = 3, 24, (1, 2, 3)
#: Salted groups of documents of one source and size: at least so many, and one for so many documents.
SALTS, SALTED = 32, 20_000_000


def _sized() -> tuple[Column, Column, Column]:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(*_sized())


def numbered(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """rows with nth (from 1) in an order and, by the names given, the sums of columns over all rows before.

    Rows are dealt out by range, numbered and summed within each part, and moved on by the totals of the
    parts before; no task holds more than its part, and there is one total for each part.
    """
    parts = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "mix-parts-in-order")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    moved = totals.select("_part", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in ("n", *sums)])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = parts.withColumns({"nth": F.row_number().over(Window.partitionBy("_part").orderBy(*order))} | {name: F.coalesce(F.sum(c).over(within), F.lit(0)) for name, c in sums.items()})
    return own.join(F.broadcast(moved), "_part").withColumns({"nth": F.col("nth") + F.col("_n")} | {name: F.col(name) + F.col(f"_{name}") for name in sums}).drop("_part", "_n", *[f"_{name}" for name in sums])  # one row for each part


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sources (source, source_size) with target: the sources' weights share the whole, up to `most` times a source's size.

    Filling up by weight stops for the sources that are full first, so with sources in order of
    size / weight a running sum finds the level at which the others share what is left.
    """
    rows = numbered(sources.select("source", "source_size"), [F.asc_nulls_last("source")], {})
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("nth") - 1, F.lit(len(weights))).cast("int") + 1)).withColumn("full", F.col("source_size") * float(most))
    rows = rows.drop("nth").withColumn("_fill", F.col("full") / F.col("weight"))
    rows = written(numbered(rows, [F.asc("_fill"), F.asc_nulls_last("source")], {"_full_before": "full", "_weight_before": "weight"}), "mix-levels")
    whole = rows.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    if whole["size"] is None:
        return rows.select("source", "source_size", F.lit(0.0).alias("target"))
    level = (F.lit(float(whole["size"])) - F.col("_full_before")) / (F.lit(whole["weight"]) - F.col("_weight_before"))
    found = rows.where(F.col("full") > level * F.col("weight")).agg(F.min_by(level, "nth")).first()[0]
    target = F.col("full") if found is None else F.least(F.col("full"), F.lit(found) * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def balanced(classes: DataFrame, goals: DataFrame, most: int = MOST, steps: int = STEPS) -> DataFrame:
    """goals with lam, by Newton iterations over classes (source, size, n)."""
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    state = goals.select("source", "source_size", "target", "mean", F.lit(0.0).alias("lam"), F.lit(-60.0).alias("low"), F.lit(60.0).alias("high"))
    for step in range(steps):
        x = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(most)), F.exp(F.col("lam") * x))
        each = F.col("n") * F.col("size")
        sums = classes.alias("c").join(state.alias("s"), same("c", "s")).select(F.col("s.source").alias("source"), (each * rate).alias("words"), F.when(rate < most, each * x * rate).otherwise(0.0).alias("slope"))
        sums = sums.groupBy("source").agg(F.sum("words").alias("words"), F.sum("slope").alias("slope"))
        over = F.col("words") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - (F.col("words") - F.col("target")) / F.when(F.col("slope") > 0, F.col("slope"))
        state = written(
            state.alias("s").join(sums.alias("t"), same("s", "t")).select("s.source", "source_size", "target", "mean", "lam", low.alias("low"), high.alias("high"), newton.alias("newton"), F.abs(F.col("words") - F.col("target")).alias("error"))
            .withColumn("lam", F.when(F.col("newton").isNotNull() & (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high")), F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2)),
            "mix-state",
        )
        worst = state.agg(F.max(F.col("error") / F.greatest(F.col("target"), F.lit(1.0)))).first()[0]
        if worst is None or worst < 1e-4:
            break
        state = state.select("source", "source_size", "target", "mean", "lam", "low", "high")
    return state.select("source", "source_size", "target", "mean", "lam")


def rounded(classes: pd.DataFrame, most: int = MOST) -> pd.DataFrame:
    """Copies of each class of one source: largest sizes first, the words still due carried along.

    A class of n documents gets `base` copies of each and one more of the first `extra` by rank.
    """
    classes = classes.sort_values("size", ascending=False)
    due = 0.0
    base, extra = np.zeros(len(classes), np.int64), np.zeros(len(classes), np.int64)
    last = len(classes) - 1
    for i, (size, n, rate) in enumerate(zip(classes["size"], classes["n"], classes["rate"], strict=True)):
        if size:
            due += size * n * rate
            copies = min(n * most, max(0, int(due / size + 0.5) if i < last else round(due / size)))
            due -= copies * size
            base[i], extra[i] = divmod(copies, n)
    return classes.assign(base=base, extra=extra)[["source", "size", "base", "extra"]]


def planned(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, int]:
    """(source, size, salt, before, base, extra, source_size, target) for sizes (doc_id, source, size), and the number of salts.

    Of the documents of a source, a size and a salt, `before` count as ranked before them: the first
    `extra` of all salts get one copy more than `base`. There are more salts the more documents there are.
    """
    salts = max(SALTS, sizes.count() // SALTED)
    parts = written(sizes.groupBy("source", "size", salted(salts).alias("salt")).agg(F.count(F.lit(1)).alias("n")), "mix-parts")
    classes = written(parts.groupBy("source", "size").agg(F.sum("n").alias("n")), "mix-classes")
    sources = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    means = written(sources.select("source", "source_size", F.greatest(F.lit(1.0), F.col("source_size") / F.col("docs")).alias("mean")), "mix-sources")
    goals = targets(means.select("source", "source_size"), weights, most).alias("g").join(means.alias("m"), F.col("g.source").eqNullSafe(F.col("m.source"))).select("g.source", "g.source_size", "target", "mean")
    solved = balanced(classes, written(goals, "mix-goals"), most)
    rate = F.when(F.col("target") >= most * F.col("source_size"), float(most)).otherwise(F.least(F.lit(float(most)), F.exp(F.col("lam") * F.col("size") / F.col("mean"))))
    rates = classes.alias("c").join(solved.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).select("c.source", "size", "n", rate.alias("rate"))
    copies = written(rates.groupBy("source").applyInPandas(lambda pdf: rounded(pdf, most), "source string, size long, base long, extra long"), "mix-copies")

    before = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    both = offsets.alias("o").join(copies.alias("c"), F.col("o.source").eqNullSafe(F.col("c.source")) & (F.col("o.size") == F.col("c.size"))).select("o.source", "o.size", "salt", "before", "base", "extra")
    both = both.alias("b").join(solved.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select("b.source", "size", "salt", "before", "base", "extra", "source_size", "target")
    return written(both, "mix-plan"), salts


def salted(salts: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")


def assigned(rows: DataFrame, plan: DataFrame, salts: int, order: list[str]) -> DataFrame:
    """rows (doc_id, source, size and more) with source_size, target and copies; repeated rows count one by one."""
    # Ranks and join share their keys, none of them null, so that rows are shuffled once.
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key")
    ranked = rows.select("*", key, salted(salts).alias("salt")).withColumn("nth", F.row_number().over(Window.partitionBy("key", "size", "salt").orderBy(*order)) - 1)
    joined = ranked.join(plan.select(key, "size", "salt", "before", "base", "extra", "source_size", "target"), ["key", "size", "salt"])
    n_copies = F.col("base") + F.when(F.col("nth") + F.col("before") < F.col("extra"), 1).otherwise(0)
    return joined.select(*rows.columns, "source_size", "target", n_copies.alias("copies"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (copies * size)."""
    sizes = written(sized(docs), "mix-sizes")
    return assigned(sizes, *planned(sizes, weights, most), ["doc_id"]).withColumn("taken", F.col("copies") * F.col("size"))


def repeated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """docs with each row as many times as the mix takes it, with all its columns; repeated rows count one by one."""
    plan, salts = planned(written(sized(docs), "mix-sizes"), weights, most)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_sized()).withColumn("hash", F.xxhash64("row.text"))
    taken = assigned(rows, plan, salts, ["doc_id", "hash"]).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select("row.*")
