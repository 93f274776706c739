"""Spans of regular expressions as native columns. Places count code points, ends are exclusive.

Every function takes time about linear in the number of spans of a text: arrays grow by blocks, not
by one element at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a block of an array.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once; within a lambda function a column would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_blocks(values: Column) -> Column:
    """A non-empty array cut into arrays of ``BLOCK`` elements."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))


def running(values: Column, combine: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each of an array of integers the combination (sum, least, most) of ``zero`` and all up to it."""
    none = F.array().cast("array<int>")

    def scan(xs: Column, start: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return F.struct(combine(acc["at"], x).alias("at"), F.array_append(acc["out"], combine(acc["at"], x)).alias("out"))

        return F.aggregate(xs, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def chained(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero, combine))
        starts = let(totals, lambda t: F.slice(F.concat(F.array(zero), scan(t, zero)), F.lit(1), F.size(t)))
        return F.flatten(F.zip_with(blocks, starts, scan))

    return F.when(F.size(values) > 0, let(values, lambda xs: let(in_blocks(xs), chained))).otherwise(none)


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b, F.lit(0))


def spans(text: Column, pattern: str, present: Column | None = None, before: int = 0) -> Column:
    """All leftmost non-overlapping matches as an array of ``match, before, start, end``.

    The pieces between matches are what ``split`` gives, so their lengths and those of the matches
    sum up to the places. The last ``before`` characters of the piece that precedes a match are kept.
    ``present`` is a cheap test that every text with a match passes; the others aren't searched.
    """

    def place(found: Column) -> Column:
        def ended(gaps: Column) -> Column:
            ends = running_sum(F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m)))
            pairs = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("match"), (F.right(g, F.lit(before)) if before else F.lit("")).alias("before")))
            return F.zip_with(pairs, ends, lambda p, e: F.struct(p["match"].alias("match"), p["before"].alias("before"), (e - F.length(p["match"])).alias("start"), e.alias("end")))

        return let(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), ended)

    test = text.rlike(pattern) if present is None else present
    none = F.array().cast("array<struct<match:string,before:string,start:int,end:int>>")
    return F.when(test, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)).otherwise(none)


def contains_any(text: Column, *words: str) -> Column:
    test = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        test = test | F.contains(text, F.lit(word))
    return test


def tagged(found: Column, kind: str, order: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """``found`` as ``order, start, end, kind``, those that ``keep`` holds of the match for."""
    if keep is not None:
        found = F.filter(found, lambda s: keep(s["match"]))
    return F.transform(found, lambda s: F.struct(F.lit(order).alias("order"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def joined(found: Column, by_start: bool) -> Column:
    """``kind:start:end`` of tagged spans, comma-joined, by start then kind or by kind then start."""
    keys = ("start", "order", "end", "kind") if by_start else ("order", "start", "end", "kind")
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(*[s[k].alias(k) for k in keys])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def blotted(text: Column, found: Column, mark: str) -> Column:
    """``text`` with each stretch that spans cover replaced by ``mark``; a span that begins where the last ended gets a mark of its own.

    Texts are cut block by block of spans, so that a place is never sought from the start of a long text.
    """
    most = lambda a, b: F.greatest(a, b)

    def cut(sorted_: Column) -> Column:
        ends = running(F.transform(sorted_, lambda s: s["end"]), most, F.lit(0))

        def pieces(ends: Column) -> Column:
            from_ = F.slice(F.concat(F.array(F.lit(0)), ends), F.lit(1), F.size(sorted_))
            places = F.filter(F.zip_with(from_, sorted_, lambda a, s: F.struct(a.alias("a"), s["start"].alias("b"))), lambda p: p["b"] >= p["a"])

            def block(ps: Column) -> Column:
                first = F.element_at(ps, 1)["a"]
                part = F.substr(text, first + 1, F.element_at(ps, -1)["b"] - first)
                return let(F.struct(part.alias("part"), first.alias("first")), lambda x: F.transform(ps, lambda p: F.substr(x["part"], p["a"] - x["first"] + 1, p["b"] - p["a"])))

            kept = let(places, lambda ps: F.flatten(F.transform(in_blocks(ps), block)))
            return F.concat(F.array_join(kept, mark), F.lit(mark), F.substr(text, F.element_at(ends, -1) + 1, F.length(text)))

        return let(ends, pieces)

    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return F.when(F.size(found) > 0, let(ordered, cut)).otherwise(text)
