"""Document fingerprints: Merkle trees over paragraphs and sections, in DataFrame functions only.

Paragraphs are the leaves: parts of at most ``WIDTH`` characters that end at marks of punctuation or
line feeds, so that texts of one long line have them too. A section is a run of paragraphs up to one
whose hash begins with a zero, so its borders depend on what it says and not on its place: an edit
changes the sections that it touches, and those after it stay what they were. A paragraph's hash
covers its text, a section's the hashes of its paragraphs, and the root those of the sections.

A fingerprint is the whole tree as a string: ``root:section|section|...``, where a section is
``hash=leaf,leaf,...`` and a leaf ``hash.length``. The root is a whole SHA-256; a section's hash is
cut to 16 digits and a leaf's to 12. Equal roots mean equal texts. Likeness and the places of edits come
from two fingerprints alone, by descending into the sections that only one of them has.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.llm.common import documents, text_or_empty
from nearfield.llm.spans import let, running_sum

WIDTH = 64
PARAGRAPH = rf"[^.!?,;:\n]{{1,{WIDTH}}}+[.!?,;:\n]*+|[.!?,;:\n]++"
#: Documents of one range of ids, which are sorted together to find neighbours, and the most ranges: their borders (8 bytes each) are what the driver holds.
RANGE_ROWS, MOST_RANGES = 2_000, 1 << 16


def paragraphs(text: Column) -> Column:
    """The paragraphs, which together are the whole text."""
    return F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0))


def fingerprint(text: Column) -> Column:
    """The tree of a text, which must not be null."""
    leaf = lambda p: let(F.sha2(p, 256), lambda h: F.concat(h, F.lit("."), F.length(p).cast("string"), F.when(F.startswith(h, F.lit("0")), "|").otherwise(",")))
    sections = F.filter(F.split(F.array_join(F.transform(paragraphs(text), leaf), ""), r"\|"), lambda s: s != "")

    def tree(sections: Column) -> Column:
        def rooted(hashes: Column) -> Column:
            short = F.zip_with(hashes, sections, lambda h, s: F.concat(F.left(h, F.lit(16)), F.lit("="), F.regexp_replace(s, "([0-9a-f]{12})[0-9a-f]{52}", "$1")))
            return F.concat(F.sha2(F.array_join(hashes, ""), 256), F.lit(":"), F.array_join(short, "|"))

        return let(F.transform(sections, lambda s: F.sha2(s, 256)), rooted)

    return let(sections, tree)


def root(tree: Column) -> Column:
    return F.left(tree, F.lit(64))


def _sections(tree: Column) -> Column:
    return F.filter(F.split(F.substr(tree, F.lit(66), F.length(tree)), r"\|"), lambda s: s != "")


def _leaves(sections: Column) -> Column:
    """The leaves of sections, in order."""
    return F.filter(F.flatten(F.transform(sections, lambda s: F.split(F.substr(s, F.lit(18), F.length(s)), ","))), lambda x: x != "")


def _length(leaf: Column) -> Column:
    return F.substring_index(leaf, ".", -1).cast("int")


def _weight(leaves: Column) -> Column:
    return F.aggregate(leaves, F.lit(0).cast("long"), lambda n, x: n + _length(x))


def likeness(a: Column, b: Column) -> Column:
    """How alike the texts of two fingerprints are: the characters of common branches as a share of those of both trees.

    Equal roots give 1. Else the distinct sections of both count whole, and of the other sections the
    distinct paragraphs are compared. Symmetric, 0 to 1.
    """

    def descend(x: Column) -> Column:
        common = F.array_intersect(x["a"], x["b"])
        rest = let(common, lambda c: F.struct(_weight(_leaves(c)).alias("both"), F.array_distinct(_leaves(F.array_except(x["a"], c))).alias("a"), F.array_distinct(_leaves(F.array_except(x["b"], c))).alias("b")))
        both = lambda r: 2.0 * (r["both"] + _weight(F.array_intersect(r["a"], r["b"])))
        return let(rest, lambda r: both(r) / (2 * r["both"] + _weight(r["a"]) + _weight(r["b"])))

    return F.when(root(a) == root(b), 1.0).otherwise(let(F.struct(_sections(a).alias("a"), _sections(b).alias("b")), descend))


def edits(a: Column, b: Column) -> Column:
    """``start, end`` (code points of text ``a``) of each paragraph of ``a`` that ``b`` lacks, in order; none if the roots agree.

    Only sections that ``b`` lacks are looked into. Lengths of sections and paragraphs give the places.
    The cost is linear in the trees, and quadratic in the paragraphs of differing sections.
    """
    none = F.array().cast("array<struct<start:int,end:int>>")

    def descend(x: Column) -> Column:
        def inside(y: Column) -> Column:
            flags = F.flatten(F.transform(x["a"], lambda s: F.transform(_leaves(F.array(s)), lambda p: F.struct(_length(p).alias("n"), (F.array_contains(y["open"], s) & ~F.array_contains(y["other"], p)).alias("new")))))
            return let(flags, lambda f: F.filter(F.zip_with(f, running_sum(F.transform(f, lambda p: p["n"])), lambda p, e: F.when(p["new"], F.struct((e - p["n"]).alias("start"), e.alias("end")))), lambda r: r.isNotNull()))

        return let(F.struct(F.array_except(x["a"], x["b"]).alias("open"), F.array_distinct(_leaves(F.array_except(x["b"], x["a"]))).alias("other")), inside)

    return F.when(root(a) == root(b), none).otherwise(let(F.struct(_sections(a).alias("a"), _sections(b).alias("b")), descend))


def merkle_trees(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of each row of ``docs(doc_id, text)``.

    A null text counts as empty, a tree of no sections. Null and repeated ids are rows like others;
    an empty table gives no rows; other columns are ignored. Very long texts are hashed whole, in time
    linear in their length; a fingerprint takes about 16 characters for each paragraph.
    """
    return docs.select("doc_id", fingerprint(text_or_empty().cast("string")).alias("fingerprint"))


def with_next_text(docs: DataFrame) -> DataFrame:
    """``doc_id, text, next`` of each row of ``docs(doc_id, text)``: the text of the row after it in descending order of doc_id, after the last the first.

    Ids are cut into ranges at quantiles, and each range is sorted by itself. So that its last row
    finds its successor, the first row of the following range is put in a second time. Texts move
    once. Nulls come last; rows with equal ids are ordered by text and are sorted in one task, which
    ids that identify documents never make large. Only the borders of ranges (``MOST_RANGES`` at most)
    reach the driver.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text"))
    ids = docs.select("doc_id")
    ranges = max(1, min(MOST_RANGES, ids.count() // RANGE_ROWS))
    borders = ids.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)] or [0.5], max(20_000, 4 * ranges))).first()[0] or []
    splits = [float("-inf"), *(sorted({float(x) for x in borders}) or [0.0]), float("inf")]
    last = len(splits) - 1
    cut = Bucketizer(splits=splits, inputCol="__value", outputCol="__bucket", handleInvalid="keep")

    def ranged(df: DataFrame) -> DataFrame:
        b = F.col("__bucket").cast("int")
        placed = cut.transform(df.withColumn("__value", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("nan")))))
        return placed.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(F.lit(last - 1) - b)).drop("__value", "__bucket")

    rows = ranged(docs)
    tops = ranged(ids).groupBy("range").agg(F.max("doc_id").alias("doc_id"))
    # At most MOST_RANGES + 1 rows: the range before each, and before the first the last.
    whole = Window.orderBy("range")
    before = tops.select("range", F.coalesce(F.lag("range").over(whole), F.max("range").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"))
    some = rows.join(F.broadcast(tops.select("range", F.col("doc_id").alias("top"))), "range").filter(F.col("doc_id").eqNullSafe(F.col("top")))
    firsts = some.groupBy("range").agg(F.max(F.struct("doc_id", "text")).alias("first")).join(F.broadcast(before), "range")
    again = firsts.select("first.doc_id", "first.text", F.col("to").alias("range"), F.lit(True).alias("again"))
    w = Window.partitionBy("range").orderBy("again", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    every = rows.withColumn("again", F.lit(False)).unionByName(again)
    return every.withColumn("next", F.lead("text").over(w)).filter("not again").select("doc_id", "text", "next")


def op7_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of ``documents`` and of their edited texts, and how alike these and the next document's are."""
    rows = with_next_text(documents(spark, sf_dir))
    n = F.length("text")
    tail = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), n - tail), F.substr("next", F.lit(1), tail)))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *[fingerprint(F.col(c)).alias(f) for c, f in (("text", "fingerprint"), ("edited", "edited_fingerprint"), ("next", "next_fingerprint"))])
    near = [likeness(F.col("fingerprint"), F.col(f"{c}_fingerprint")).alias(f"near_{c}") for c in ("edited", "next")]
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near)
