"""N-gram Jaccard join by vertical partitioning.

The n-grams have a global order: frequent ones last, then by hash. It is cut at quantiles of their
occurrences into ``FRAGMENTS`` fragments. Two documents can reach the threshold only if they share an
n-gram among the rarest of each, so these prefixes give candidate pairs. Of each candidate pair the
overlap is counted fragment by fragment, and the partial counts are summed per pair.

Documents with equal sets are one class, of which one row takes part. All links between classes, or
their number for each document, come from comparing all candidates. Where components alone are
wanted, the candidates of an n-gram are first compared with one pivot, and afterwards only those that
the links found so far leave in different components are compared with each other. A group of near
copies thus costs comparisons in proportion to its size, and no link between different components is
lost.

No task gets a whole frequent n-gram: its sets are dealt into parts of about ``PART`` sets, its pivot is
the greatest of what each task finds, and what is left to compare meets in cells of two parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.llm.common import Scratch, bound_batches, broadcast_if_small, documents
from nearfield.llm.components import connected_components
from nearfield.llm.recent import forget

#: Slots of the table of frequent n-grams: one byte each, whatever the input's size.
SLOTS = 1 << 20
#: N-grams of fewer documents rank as rare.
FREQUENT = 8
#: A task packs its n-grams for counting once it has this many, or four for each range of hashes.
PACKED = 1_500_000
#: Fragments of the global order, and the parts of a level of it where a cut may lie.
FRAGMENTS, STEPS = 8, 256
#: Sets of a part of a frequent n-gram, about.
PART = 512


def _multipliers(words: int) -> np.ndarray:
    return np.random.default_rng(20_000 + words).integers(1 << 62, (1 << 63) - 1, words, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word n-grams; A-Z are lower-cased."""
    from xxhash import xxh64_intdigest

    factors = {n: _multipliers(n) for n in range(1, words + 1)}
    for text in texts:
        split = text.encode().lower().split() if text else ()
        n = min(words, len(split))
        if not n:
            yield np.zeros(0, np.int64)
            continue
        hashes = np.fromiter(map(xxh64_intdigest, split), np.uint64, len(split))
        many = len(split) - n + 1
        mixed = hashes[:many] * factors[n][0]
        for k in range(1, n):
            mixed += hashes[k : k + many] * factors[n][k]
        yield np.unique(mixed.view(np.int64))


def _key(grams: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(grams.tobytes())).astype(np.int64))


def _prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams >> 24) & (SLOTS - 1)


def _packed(docs: DataFrame, words: int, ranges: int) -> DataFrame:
    """``range, packed``: the first 40 bits of the n-grams with their counts, some millions at a time: an n-gram of every document is one entry of each. They are sorted, as differences in byte planes, then the counts' planes."""
    shift, most = np.uint64(40 - ranges.bit_length() + 1), max(PACKED, 4 * ranges)

    def pack(grams: list[np.ndarray]) -> pa.RecordBatch:
        import zstandard

        tops, counts = np.unique(np.concatenate(grams).view(np.uint64) >> np.uint64(24), return_counts=True)
        cuts = np.searchsorted(tops >> shift, np.arange(ranges + 1, dtype=np.uint64))
        planes = counts.astype("<u4").view(np.uint8).reshape(-1, 4)
        code, rows = zstandard.ZstdCompressor(level=1), []
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(cuts[k], cuts[k + 1])
            steps = np.diff(tops[own], prepend=np.uint64(k) << shift).view(np.uint8).reshape(-1, 8)[:, :5]
            rows.append((k, code.compress(np.concatenate([steps, planes[own]], axis=1).T.tobytes())))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["range", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held, n = [], 0
        for batch in batches:
            for grams in shingle_sets(batch.column(1).to_pylist(), words):
                held.append(grams)
                n += len(grams)
                if n > most:
                    yield pack(held)
                    held, n = [], 0
        if n:
            yield pack(held)

    return docs.mapInArrow(run, "range int, packed binary")


def _order(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The global order, of a fixed size on the driver.

    For each slot the binary logarithm of its most frequent n-gram's count over all documents, 0 if
    none is frequent: the level by which n-grams are ordered first. And the borders of the fragments,
    as places of the order (see :func:`_place`), by quantiles of the levels' occurrences.
    """
    ranges = 1 << max(8, (4 * docs.rdd.getNumPartitions()).bit_length())
    shift = np.uint64(40 - ranges.bit_length() + 1)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        code, tops, counts = zstandard.ZstdDecompressor(), [], []
        for k, packed in zip(pdf["range"], pdf["packed"], strict=True):
            planes = np.frombuffer(code.decompress(packed), np.uint8).reshape(9, -1).T
            steps = np.zeros((len(planes), 8), np.uint8)
            steps[:, :5] = planes[:, :5]
            tops.append(np.cumsum(steps.view(np.uint64).ravel()) + (np.uint64(k) << shift))
            counts.append(np.ascontiguousarray(planes[:, 5:]).view("<u4").ravel())
        values, at = np.unique(np.concatenate(tops), return_inverse=True)
        sums = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
        often = sums >= FREQUENT
        level = np.where(often, np.log2(np.maximum(sums, 1)), 0).astype(np.int32)
        slots = pd.DataFrame({"slot": (values[often] & np.uint64(SLOTS - 1)).astype(np.int32), "level": level[often], "n": 0})
        total = np.bincount(level, weights=sums)
        on = np.flatnonzero(total)
        return pd.concat([slots.groupby("slot", as_index=False).max(), pd.DataFrame({"slot": -1 - on, "level": on, "n": total[on]})]).astype({"slot": "int32", "level": "int32", "n": "int64"})

    found = _packed(docs, words, ranges).groupBy("range").applyInPandas(count, "slot int, level int, n long").groupBy("slot").agg(F.max("level").alias("level"), F.sum("n").alias("n")).toArrow()
    slot, level, n = (found.column(c).to_numpy() for c in ("slot", "level", "n"))
    table, total = np.zeros(SLOTS, np.uint8), np.zeros(64)
    table[slot[slot >= 0]] = level[slot >= 0]
    total[level[slot < 0]] = n[slot < 0]
    before = np.concatenate([[0], np.cumsum(total)])
    wanted = np.arange(1, FRAGMENTS) * before[-1] / FRAGMENTS
    at = np.clip(np.searchsorted(before, wanted, side="right") - 1, 0, 63)
    borders = at * STEPS + np.floor((wanted - before[at]) / np.maximum(total[at], 1) * STEPS).astype(np.int64)
    return table, borders


def _place(level: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Where n-grams stand in the global order: by level, then by the first bits of the hash."""
    return level.astype(np.int64) * STEPS + (grams >> 56) + 128


def _heads(docs: DataFrame, words: int, percent: int, order) -> DataFrame:
    """Of each document its set's size and key, and the n-grams of its prefix in the global order with their levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, _ = order.value
        for batch in batches:
            n, keys, heads, levels = [], [], [], []
            for grams in shingle_sets(batch.column(1).to_pylist(), words):
                n.append(len(grams))
                keys.append(_key(grams))
                level = table[_slot(grams)]
                first = np.argsort(level, kind="stable")[: _prefix(len(grams), percent) if len(grams) else 0]
                heads.append(grams[first])
                levels.append(level[first].astype(np.int8))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n": pa.array(n, pa.int64()), "key": pa.array(keys, pa.int64()), "head": pa.array(heads, pa.list_(pa.int64())), "levels": pa.array(levels, pa.list_(pa.int8()))})

    return docs.mapInArrow(run, "doc_id long, n long, key long, head array<long>, levels array<byte>")


def _widest() -> Column:
    """Of an n-gram's sets the pivot is the one with the widest reach for its size."""
    return F.struct((F.col("reach").cast("long") * 1000 / F.col("n")).cast("int").alias("share"), "n", "key", "reach")


def _shared(heads: DataFrame, classes: DataFrame, percent: int, repeated: bool) -> DataFrame:
    """``gram, part, parts, key, n, reach, pivot`` of the prefix n-grams that different sets have, one row of each class.

    A partner whose first common n-gram is this one has at most ``reach`` n-grams: beyond it the
    n-grams that remain here are too few. One exchange serves all: the sets of an n-gram, or of a part
    of a frequent one, meet and tell whether they differ, and which of them is its ``pivot``.
    """
    several = broadcast_if_small(classes).withColumnRenamed("n", "size")
    one = heads.join(several, "key", "left").filter(F.col("first").isNull() | F.col("doc_id").eqNullSafe(F.col("first")))
    each = one.select("key", "n", F.posexplode(F.arrays_zip("head", "levels")).alias("at", "g"))
    reach = F.floor(((100 + percent) * (F.col("n") - F.col("at")) - percent * F.col("n")) / percent).cast("int")
    # A level says that no n-gram of its slot has twice as many documents.
    parts = F.greatest(F.lit(1), F.floor(F.pow(F.lit(2.0), F.col("g.levels") + 1) / PART).cast("int"))
    each = each.select(F.col("g.head").alias("gram"), "key", F.col("n").cast("int").alias("n"), reach.alias("reach"), parts.alias("parts"))
    each = each.withColumn("part", F.pmod(F.hash("key"), F.col("parts")))
    group = Window.partitionBy("gram", "part")
    pivot = F.max(_widest()).over(group)
    met = each.withColumn("least", F.min("key").over(group)).withColumn("most", F.max("key").over(group)).withColumn("pivot", pivot)
    met = met.filter((F.col("parts") > 1) | (F.col("least") < F.col("most")))
    met = met.select("gram", "part", "parts", "key", "n", "reach", F.struct("pivot.key", "pivot.n", "pivot.reach").alias("pivot"))
    return met.distinct() if repeated else met


def _fragments(docs: DataFrame, words: int, order) -> DataFrame:
    """``key, n, fragment, grams``: each set cut at the borders of the fragments of the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, borders = order.value
        for batch in batches:
            rows: list[tuple] = []
            for grams in shingle_sets(batch.column(1).to_pylist(), words):
                if n := len(grams):
                    key = _key(grams)
                    at = np.searchsorted(borders, _place(table[_slot(grams)], grams), side="right")
                    rows += [(key, n, k, grams[at == k]) for k in np.unique(at).tolist()]
            if rows:
                key, n, k, own = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array(k, pa.int32()), pa.array(own, pa.list_(pa.int64()))], ["key", "n", "fragment", "grams"])

    return docs.mapInArrow(run, "key long, n long, fragment int, grams array<long>")


def _linked(pairs: DataFrame, plan: _Plan, name: str) -> DataFrame:
    """Those of ``pairs(a, na, b, nb)`` that reach the threshold: partial overlaps by fragment, summed per pair.

    The texts of both ends are cut anew rather than kept, each where it lies. Ends and pairs are
    broadcast within a checked size; beyond it they meet by exchange.
    """
    hinted = broadcast_if_small(pairs)

    def cut(key: str, n: str, out: str) -> DataFrame:
        ends = plan.scratch.table(pairs.select(F.col(key).alias("key"), F.col(n).cast("long").alias("n")).distinct(), f"{name}-{key}")
        ends = broadcast_if_small(ends)
        one = broadcast_if_small(plan.scratch.table(plan.sets.join(ends, ["key", "n"], "left_semi").groupBy("key", "n").agg(F.min("doc_id").alias("one")).select("one").distinct(), f"{name}-{key}-one"))
        texts = plan.docs.join(one, plan.docs["doc_id"].eqNullSafe(one["one"]), "left_semi")
        found = _fragments(texts, plan.words, plan.order).join(ends, ["key", "n"], "left_semi")
        found = found.dropDuplicates(["key", "n", "fragment"]) if plan.repeated else found
        return found.select(F.col("key").alias(key), F.col("n").alias(n), "fragment", F.col("grams").alias(out))

    both = cut("a", "na", "x").join(hinted, ["a", "na"]).join(cut("b", "nb", "y"), ["b", "nb", "fragment"])
    partial = both.select("a", "na", "b", "nb", F.size(F.array_intersect("x", "y")).cast("long").alias("common"))
    total = partial.groupBy("a", "na", "b", "nb").agg(F.sum("common").alias("common"))
    found = plan.scratch.table(total.filter(F.col("common") * 100 >= plan.percent * (F.col("na") + F.col("nb") - F.col("common"))), f"{name}-links")
    plan.scratch.drop(f"{name}-a", f"{name}-b", f"{name}-a-one", f"{name}-b-one")
    return found


def _fits(a: str = "", b: str = "2") -> Column:
    return (F.col(f"n{a}") <= F.col(f"reach{b}")) & (F.col(f"n{b}") <= F.col(f"reach{a}"))


def _in_cells(rows: DataFrame, scratch: Scratch, *columns: str) -> DataFrame:
    """Every two of ``rows(gram, key, n, reach, ...)`` with one n-gram that may reach the threshold, each once: the second with ``2`` after its columns' names.

    The rows of an n-gram are dealt into blocks of about ``PART``, and every two blocks meet in a
    cell of their own, so a frequent n-gram's comparisons are spread over many tasks, and pairs that
    sizes and places exclude are never rows.
    """
    count = rows.groupBy("gram").count().filter(F.col("count") > PART).select("gram", F.ceil(F.col("count") / PART).cast("int").alias("blocks"))
    held = rows.join(broadcast_if_small(scratch.table(count, "blocks")), "gram", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.hash("key", "n"), F.col("blocks")))
    kept = ["key", "n", "reach", *columns]
    left = held.select("gram", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), *kept)
    right = held.select("gram", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"), *[F.col(c).alias(f"{c}2") for c in kept])
    once = (F.col("i") < F.col("j")) | (F.col("key") < F.col("key2")) | ((F.col("key") == F.col("key2")) & (F.col("n") < F.col("n2")))
    return left.join(right, ["gram", "i", "j"]).filter(once & _fits())


def _pairs(x: DataFrame) -> DataFrame:
    """Distinct pairs of a row's own set and the second one."""
    return x.select(F.col("key").alias("a"), F.col("n").cast("long").alias("na"), F.col("key2").alias("b"), F.col("n2").cast("long").alias("nb")).distinct()


def _all_links(shared: DataFrame, plan: _Plan) -> DataFrame:
    """All links: every two different sets that have an n-gram of both prefixes, as far as their sizes allow, are compared."""
    pairs = _in_cells(shared.select("gram", "key", "n", "reach"), plan.scratch)
    first = (F.col("key") < F.col("key2")) | ((F.col("key") == F.col("key2")) & (F.col("n") < F.col("n2")))
    ordered = pairs.select(*[F.when(first, F.col(c)).otherwise(F.col(f"{c}2")).alias(c) for c in ("key", "n")], *[F.when(first, F.col(f"{c}2")).otherwise(F.col(c)).alias(f"{c}2") for c in ("key", "n")])
    return _linked(plan.scratch.table(_pairs(ordered), "every"), plan, "every")


def _connecting_links(shared: DataFrame, plan: _Plan) -> DataFrame:
    """Links that leave the same components as all do."""
    scratch = plan.scratch
    tops = shared.filter("parts > 1").groupBy("gram").agg(F.max(_widest()).alias("pivot"))
    tops = scratch.table(tops.select("gram", F.struct("pivot.key", "pivot.n", "pivot.reach").alias("top")), "tops")
    whole = shared.filter("parts = 1").withColumn("top", F.col("pivot"))
    parted = shared.filter("parts > 1").join(broadcast_if_small(tops), "gram")
    with_pivot = whole.unionByName(parted).select("key", "n", "reach", *[F.col(f"top.{c}").alias(f"{c}2") for c in ("key", "n", "reach")])
    differ = (F.col("key") != F.col("key2")) | (F.col("n") != F.col("n2"))
    star = scratch.table(_pairs(with_pivot.filter(differ & _fits())), "star")
    links = _linked(star, plan, "star")
    comps = scratch.table(connected_components(links, scratch, "first"), "comps")
    member = shared.select("gram", "key", "n", "reach").join(broadcast_if_small(comps).withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    # Most n-grams have sets of one component only, and nothing is left to compare.
    mixed = member.groupBy("gram").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least < most").select("gram")
    mixed = scratch.table(mixed, "mixed")
    member = scratch.table(member.join(broadcast_if_small(mixed), "gram", "left_semi"), "member")
    # Per n-gram the widest reach and the least size, each with the next that another component has: who finds no fit there is done.
    groups = member.groupBy("gram", "comp").agg(F.max("reach").alias("r"), F.min("n").alias("s"))
    best = groups.groupBy("gram").agg(F.max(F.struct("r", "comp")).alias("r1"), F.min(F.struct("s", "comp")).alias("s1"))
    next_ = groups.join(best, "gram").groupBy("gram").agg(
        F.first("r1").alias("r1"), F.first("s1").alias("s1"), F.max(F.when(F.col("comp") != F.col("r1.comp"), F.col("r"))).alias("r2"), F.min(F.when(F.col("comp") != F.col("s1.comp"), F.col("s"))).alias("s2")
    )
    next_ = scratch.table(next_, "next")
    reach = F.when(F.col("comp") == F.col("r1.comp"), F.col("r2")).otherwise(F.col("r1.r"))
    least = F.when(F.col("comp") == F.col("s1.comp"), F.col("s2")).otherwise(F.col("s1.s"))
    live = scratch.table(member.join(next_, "gram").filter((reach >= F.col("n")) & (least <= F.col("reach"))).select("gram", "key", "n", "reach", "comp"), "live")
    scratch.drop("mixed", "member", "next", "shared")
    open_ = _pairs(_in_cells(live, scratch, "comp").filter("comp <> comp2"))
    known = star.unionByName(star.select(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb")))
    open_ = scratch.table(open_.join(known, ["a", "na", "b", "nb"], "left_anti"), "rest")
    found = links.unionByName(_linked(open_, plan, "rest"))
    scratch.drop("live", "rest", "star")
    return found


@dataclass
class _Plan:
    """What the steps of one join have in common: ``sets(doc_id, n, key)``, the texts, and the broadcast order."""

    sets: DataFrame
    docs: DataFrame
    words: int
    percent: int
    order: object
    repeated: bool
    scratch: Scratch


def _prepared(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, _Plan]:
    """``shared``, the classes of several rows, and the plan."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = spark.sparkContext.broadcast(_order(docs, words))
    held = scratch.table(_heads(docs, words, percent, order), "heads")
    sets = scratch.table(held.select("doc_id", "n", "key"), "sets")
    repeated = bool(sets.groupBy("doc_id").count().filter("count > 1").limit(1).count())
    classes = scratch.table(sets.groupBy("key", "n").agg(F.min("doc_id").alias("first"), F.count("*").alias("many")).filter("many > 1").select("key", "n", "first"), "classes")
    # Rows without ids can't be told from each other, and all stay.
    shared = scratch.table(_shared(held, classes.filter("first is not null"), percent, repeated), "shared")
    scratch.drop("heads")
    scratch.release()
    return shared, classes, _Plan(sets, docs, words, percent, order, repeated, scratch)


def ngram_join(docs: DataFrame, words: int = 4, percent: int = 85, links: bool = False) -> DataFrame:
    """Link documents whose sets of distinct word n-grams have a Jaccard likeness of ``percent`` / 100 or more.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text with A-Z lower-cased; a text of fewer than
    ``words`` words has its whole sequence as one n-gram. Returns a row for each row of
    ``docs(doc_id, text)``: ``doc_id, n_shingles, component_id, class_key``, where ``component_id``
    is the least doc_id that links reach, itself included, and equal sets share ``class_key``.

    With ``links`` all candidates are compared, and ``n_links`` is the number of other classes whose
    sets are linked with the row's; its cost grows with the links that there are. ``ngram_links``
    gives the links themselves. Without it only components are wanted, and most links in them are
    never looked at.

    A text that is null or without words has an empty set, which links with nothing. Null ids take
    part but are never a component's id unless it has no other. Repeated rows give repeated rows.
    An empty table gives no rows; other columns are ignored. Sets are compared by 64-bit hashes. A very
    long text is one set like others, held whole by one task.
    """
    shared, classes, plan = _prepared(docs, words, percent)
    sets, scratch = plan.sets, plan.scratch
    found = (_all_links if links else _connecting_links)(shared, plan)
    comps = scratch.table(connected_components(found, scratch, "all"), "all-comps")
    linked = sets.join(broadcast_if_small(comps).withColumnRenamed("node", "key"), "key").filter("n > 0").groupBy("key", "n", "comp").agg(F.min("doc_id").alias("first"))
    linked = scratch.table(linked, "linked")
    least = scratch.table(linked.groupBy("comp").agg(F.min("first").alias("component")), "least")
    # Both sides are tables, so that Spark broadcasts the one or splits a component of very many classes.
    ids = linked.join(broadcast_if_small(least), "comp").select("key", "n", "component")
    copies = classes.filter("n > 0").select("key", "n", F.col("first").alias("component")).join(linked.select("key", "n"), ["key", "n"], "left_anti")
    ids = scratch.table(ids.unionByName(copies), "ids")
    out = sets.join(broadcast_if_small(ids), ["key", "n"], "left")
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.col("key").alias("class_key")]
    if not links:
        scratch.drop("classes", "all-comps", "linked", "least", "comps", "star-links", "rest-links")
        scratch.release()
        return out.select(*columns)
    each = found.select(F.col("a").alias("key"), F.col("na").alias("n")).unionAll(found.select("b", "nb")).groupBy("key", "n").agg(F.count("*").alias("n_links"))
    return out.join(each, ["key", "n"], "left").select(*columns, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def ngram_links(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """All links between classes of equal sets of ``docs(doc_id, text)``, each once: ``doc_a, n_a, doc_b, n_b, common``.

    ``doc_a`` and ``doc_b`` are the least doc_ids of their classes, null if none has one; the class of the lesser key
    comes first. ``n_a`` and ``n_b`` are the sets' sizes. Otherwise as ``ngram_join``.
    """
    shared, _, plan = _prepared(docs, words, percent)
    first = plan.sets.groupBy("key", "n").agg(F.min("doc_id").alias("doc"))
    found = _all_links(shared, plan)
    for c in "ab":
        found = found.join(first.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("doc").alias(f"doc_{c}")), [c, f"n{c}"])
    return found.select("doc_a", F.col("na").alias("n_a"), "doc_b", F.col("nb").alias("n_b"), "common")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` by four-word n-grams at 0.85."""
    return ngram_join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
