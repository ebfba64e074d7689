"""Document fingerprints: a Merkle tree over sections, paragraphs and clauses.

A section ends with a blank line, a paragraph with a line break, a clause (the leaf) after punctuation
or 32 characters. All separators belong to the piece that they end, so a text is the concatenation of
its leaves and equal roots mean equal texts. A node's hash is that of its children's hashes; differing
branches show which paragraphs were edited. Only DataFrame functions are used.

A fingerprint string is the root and the leaves' short hashes. The likeness of two fingerprints is
Dice's coefficient of their distinct leaves: 2 * common / (leaves of one + leaves of the other); two
empty texts are alike.

Defined results: a null text counts as empty; "next" goes by descending doc_id (null last), among
repeated ids by a hash of the text, and wraps around, so a single document is its own next; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAF = r"[^.!?,;:|\n]{1,32}[.!?,;:|\n]*|[.!?,;:|\n]+"
SHORT = 8
#: Documents in a range of ids, and the most ranges: beyond 16 million documents ranges grow, and each sorts and spills on its own.
RANGE, RANGES = 500, 32_768
LEAST = -(2**63)


def tree(text: Column) -> Column:
    """struct(root, sections: array of struct(hash, paragraphs: array of struct(hash, leaves)))."""
    cut = lambda c, end: F.filter(F.split(c, end), lambda x: x != "")
    joined = lambda nodes: F.md5(F.array_join(F.transform(nodes, lambda n: n["hash"]), ""))

    def paragraph(p: Column) -> Column:
        leaves = F.transform(F.regexp_extract_all(p, F.lit(LEAF), 0), lambda x: F.md5(x))
        return F.transform(F.array(leaves), lambda hashes: F.struct(F.md5(F.array_join(hashes, "")).alias("hash"), hashes.alias("leaves")))[0]

    def section(s: Column) -> Column:
        paragraphs = F.transform(cut(s, r"(?<=\n)(?!\n)"), paragraph)
        return F.transform(F.array(paragraphs), lambda ps: F.struct(joined(ps).alias("hash"), ps.alias("paragraphs")))[0]

    sections = F.transform(cut(text, r"(?<=\n\n)(?!\n)"), section)
    return F.transform(F.array(sections), lambda ss: F.struct(joined(ss).alias("root"), ss.alias("sections")))[0]


def fingerprint(node: Column) -> Column:
    """Root and short leaf hashes of a tree as one string."""
    paragraphs = F.flatten(F.transform(node["sections"], lambda s: s["paragraphs"]))
    leaves = F.flatten(F.transform(paragraphs, lambda p: p["leaves"]))
    return F.concat(node["root"], F.lit(":"), F.array_join(F.transform(leaves, lambda h: F.substring(h, 1, SHORT)), ","))


def leaves_of(print_: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.substring_index(print_, ":", -1), ",")), lambda x: x != "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two fingerprint strings; 1 for equal ones."""
    x, y = leaves_of(a), leaves_of(b)
    total = F.size(x) + F.size(y)
    return F.when(a == b, 1.0).when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / total)


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Places (from 0) and hashes of the paragraphs of tree b that tree a lacks; empty where the roots are equal."""
    hashes = lambda t: F.transform(F.flatten(F.transform(t["sections"], lambda s: s["paragraphs"])), lambda p: p["hash"])
    placed = F.transform(hashes(b), lambda h, i: F.struct(i.alias("place"), h.alias("hash")))
    differing = F.filter(placed, lambda x: ~F.array_contains(hashes(a), x["hash"]))
    return F.when(a["root"] == b["root"], F.filter(placed, lambda x: F.lit(False))).otherwise(differing)


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs (doc_id, text and more), each with the next document's `columns` as next_<column>.

    Ranges of ids get a window each; an id (or null) with more rows than a range holds gets several, by
    a hash of the text. The first document of a range also goes, as a sentinel, to the range above,
    where it follows that one's last document; so no window spans ranges.
    """
    spark = docs.sparkSession
    docs = docs.withColumns({"_key": F.coalesce("doc_id", F.lit(LEAST)), "_hash": F.xxhash64("text")})
    ids = docs.select("_key")
    n = ids.count()
    count = min(RANGES, max(1, n // RANGE))
    cuts = sorted(ids.agg(F.percentile_approx("_key", [i / count for i in range(1, count)], 20_000)).first()[0] or []) if count > 1 else []
    if cuts:
        # Two steps of about sqrt(ranges) comparisons find a key's range.
        wide = max(1, math.isqrt(len(cuts)))
        groups = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
        edges = lambda at: F.array(*[F.lit(g[at]).cast("long") for g in groups])
        fine = F.array(*[F.array(*[F.lit(c).cast("long") for c in g]) for g in groups])

        def place(below: Callable[[Column], Column]) -> Column:
            """How many cuts are below: those of whole groups, and of the first group whose last one is not."""
            whole = F.size(F.filter(edges(-1), below))
            return whole * wide + F.coalesce(F.size(F.filter(F.get(fine, whole), below)), F.lit(0))

        least, most = place(lambda c: c < F.col("_key")), place(lambda c: c <= F.col("_key"))
        docs = docs.withColumns({"_least": F.least(least, F.lit(len(cuts))), "_most": F.least(most, F.lit(len(cuts)))})
        share = F.pmod("_hash", F.lit(2**20)) / 2**20
        # A key that is a cut has as many ranges as it is cuts; parts of it go by the hash.
        docs = docs.withColumn("_range", F.when(F.col("_most") > F.col("_least"), F.col("_least") + 1 + F.floor(share * (F.col("_most") - F.col("_least")))).otherwise(F.col("_most")).cast("int")).drop("_least", "_most")
    else:
        docs = docs.withColumn("_range", F.lit(0))
    by_hash = F.pmod("_hash", F.lit(2**20))
    docs = docs.withColumn("_part", by_hash)
    firsts = [(r["_range"], *r["first"]) for r in docs.groupBy("_range").agg(F.max(F.struct("_key", "_part", "_hash")).alias("first")).orderBy("_range").collect()]  # one row a range
    # A range's last document is followed by the first of the range below it; the lowest range's by the very first.
    above = [(*firsts[i][1:], firsts[(i + 1) % len(firsts)][0]) for i in range(len(firsts))]
    sentinels = spark.createDataFrame(above, "_key long, _part long, _hash long, _to int").hint("broadcast")  # RANGES rows at most
    sent = docs.join(sentinels, ["_key", "_part", "_hash"]).withColumn("_range", F.col("_to")).drop("_to").dropDuplicates(["_key", "_hash", "_range"]).withColumn("_sentinel", F.lit(1))
    rows = docs.withColumn("_sentinel", F.lit(0)).unionByName(sent)
    order = Window.partitionBy("_range").orderBy("_sentinel", F.desc("_key"), F.desc("_part"), F.desc("_hash"), "text")
    return rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where(F.col("_sentinel") == 0).drop("_key", "_part", "_hash", "_range", "_sentinel")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all)
    of the next document's.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("_tree", tree(F.col("text"))).select("doc_id", "text", fingerprint(F.col("_tree")).alias("fingerprint"))
    rows = with_next(docs, ["text", "fingerprint"])
    n = F.char_length("text")
    tail = F.floor(n / 3).cast("int")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", F.concat(F.substring("text", F.lit(1), n - tail), F.substring("next_text", F.lit(1), tail)).alias("edited"))
    rows = rows.withColumn("_tree", tree(F.col("edited"))).select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("_tree")).alias("edited_fingerprint"), "next_fingerprint")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
