"""Mixing sources to target weights by hierarchical budgeting.

A budget of tokens flows down a tree of domains, languages and sources in proportion to weights.
What a node cannot fill goes to its siblings in proportion to theirs, and only what all of them
cannot fill goes to its parent's siblings. A leaf takes the prefix that its budget pays for of its
documents in seeded order, epoch after epoch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.llm.common import Scratch, bound_batches, broadcast_if_small, documents, null_safe_join
from nearfield.llm.tokens import default_tokenizer, token_counts

#: The production table of domains: the sources of each. A source that it doesn't list is of the domain ``OTHER``.
DOMAINS = {
    "web": ("src0", "src2", "src4", "src6", "src8", "src10", "src12", "src14", "src16", "src18"),
    "reference": ("src1", "src3", "src5", "src7", "src9", "src11", "src13", "src15", "src17", "src19"),
}
OTHER = "other"
#: Production weights. Domains and sources not named weigh 1; languages not named, null too, by their tokens.
DOMAIN_WEIGHTS = {"web": 3.0, "reference": 1.0}
LANG_WEIGHTS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}
#: The budget as a share of the tokens there are, and how often a document may be taken.
BUDGET_SHARE, EPOCHS = 0.9, 4
SEED = 4
#: A leaf's documents are summed up in this many ranges (a power of two) of their order, so that no leaf is sorted in one task.
RANGES = 1024


def domain_of(source: Column, domains: dict[str, tuple[str, ...]]) -> Column:
    """The domain that the table ``domains`` gives a source, ``OTHER`` if none."""
    out = F.lit(OTHER)
    for name, sources in sorted(domains.items()):
        out = F.when(source.isin(*sources), F.lit(name)).otherwise(out)
    return out


def default_tokens(text: Column) -> Column:
    """Words of the text, by white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")).cast("long")


def _weight(column: str, weights: dict[str, float]) -> Column:
    if not weights:
        return F.lit(1.0)
    pairs = [F.lit(x) for item in sorted(weights.items()) for x in item]
    return F.coalesce(F.create_map(*pairs)[F.col(column)], F.lit(1.0))


def _with_lang_weights(lang: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``lang(domain, lang, cap)`` with ``w``. Languages not named, null too, weigh by their tokens as the named ones of their domain do together; alone they share by tokens."""
    if not weights:
        return lang.withColumn("w", F.lit(1.0))
    of_domain, named = Window.partitionBy("domain"), F.coalesce(F.col("lang").isin(*weights), F.lit(False))
    tokens, weight = (F.sum(F.when(named & (F.col("__w") > 0), F.col(c))).over(of_domain) for c in ("cap", "__w"))
    rate = F.when(tokens > 0, weight / tokens).otherwise(1.0)
    lang = lang.withColumn("__w", _weight("lang", weights)).withColumn("__rate", rate)
    return lang.withColumn("w", F.when(named, F.col("__w")).otherwise(F.col("cap") * F.col("__rate"))).drop("__w", "__rate")


def fill(nodes: DataFrame, parents: list[str], node: str, capacity: str, weight: str, budget: Column, out: str) -> DataFrame:
    """Divide each parent's ``budget`` among its nodes by weight, none above its capacity.

    In ascending order of capacity by weight a node is full if its capacity is within its share of
    what the nodes before it leave; the others divide the rest by weight. Nodes of no weight get
    what is left when all others are full.
    """
    for level, test in enumerate((F.col(weight) > 0, F.col(weight) <= 0)):
        w = F.when(test, F.col(weight) if level == 0 else F.lit(1.0))
        over = Window.partitionBy(*parents, "__on").orderBy(F.col("__ratio"), F.col(node).asc_nulls_first())
        rest = budget if level == 0 else F.greatest(budget - F.coalesce(F.sum(f"{out}0").over(Window.partitionBy(*parents)), F.lit(0.0)), F.lit(0.0))
        nodes = nodes.withColumn("__w", w).withColumn("__rest", rest.cast("double")).withColumn("__on", test).withColumn("__ratio", F.col(capacity) / F.col("__w"))
        before = over.rowsBetween(Window.unboundedPreceding, -1)
        following = over.rowsBetween(0, Window.unboundedFollowing)
        level_ = (F.col("__rest") - F.coalesce(F.sum(capacity).over(before), F.lit(0.0))) / F.sum("__w").over(following)
        nodes = nodes.withColumn("__level", level_).withColumn("__full", F.col("__ratio") <= F.col("__level"))
        # The first open node's level; of nodes with equal ratios the first has the highest.
        open_ = F.min(F.when(~F.col("__full"), F.struct("__ratio", (-F.col("__level")).alias("__below")))).over(Window.partitionBy(*parents, "__on"))
        share = F.when(F.col("__full"), F.col(capacity)).otherwise(F.col("__w") * -open_["__below"])
        nodes = nodes.withColumn(f"{out}{level}", F.when(test, F.greatest(share, F.lit(0.0))).otherwise(0.0))
        nodes = nodes.drop("__w", "__rest", "__on", "__ratio", "__level", "__full")
    return nodes.withColumn(out, F.col(f"{out}0") + F.col(f"{out}1")).drop(f"{out}0", f"{out}1")


def budgets(supply: DataFrame, budget: float, epochs: int, domains: dict[str, float], langs: dict[str, float], sources: dict[str, float]) -> DataFrame:
    """``domain, lang, source, tokens, budget`` of each leaf, from its ``tokens``."""
    leaf = supply.withColumn("cap", F.col("tokens").cast("double") * epochs).withColumn("w", _weight("source", sources))
    lang = _with_lang_weights(leaf.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")), langs)
    domain = lang.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("w", _weight("domain", domains)).withColumn("root", F.lit(0))
    top = fill(domain, ["root"], "domain", "cap", "w", F.lit(budget), "given").select("domain", F.col("given").alias("of_domain"))
    middle = null_safe_join(lang, top, ["domain"])
    middle = fill(middle, ["domain"], "lang", "cap", "w", F.col("of_domain"), "given").select("domain", "lang", F.col("given").alias("of_lang"))
    low = null_safe_join(leaf, middle, ["domain", "lang"])
    low = fill(low, ["domain", "lang"], "source", "cap", "w", F.col("of_lang"), "given")
    return low.select("domain", "lang", "source", "tokens", F.floor(F.col("given") + 1e-6).cast("long").alias("budget"))


def mix(
    docs: DataFrame, budget: int | None = None, epochs: int = EPOCHS, domains: dict[str, float] = DOMAIN_WEIGHTS, langs: dict[str, float] = LANG_WEIGHTS, sources: dict[str, float] | None = None,
    seed: int = SEED, tokens: Callable[[Column], Column] = default_tokens, table: dict[str, tuple[str, ...]] = DOMAINS,
) -> tuple[DataFrame, DataFrame]:
    """Mix ``docs(doc_id, text, lang, source, ...)`` to the weights within ``budget`` tokens.

    Returns the rows taken, with all their columns and an ``epoch`` from 0 (a row that is taken
    twice appears twice), and ``domain, lang, source, tokens, budget`` of each leaf. A leaf takes
    the longest prefix of its seeded order whose tokens are within its budget, so the mix exceeds
    no budget and falls short of a leaf's by less than one document. ``table`` has the sources of each
    domain, and ``tokens`` counts a text's.

    Where that prefix ends is one place for each leaf: an epoch, a range of the order, and a place
    in it. Only that range is sorted, and the documents need no exchange to tell on which side they
    are.

    ``budget`` is ``BUDGET_SHARE`` of all tokens unless given. Null languages and sources are
    leaves of their own. Languages that ``langs`` doesn't name, null too, weigh by their tokens, at
    the rate of tokens to weight of their domain's named ones; a weight of 0 must be named. Documents without tokens cost nothing and are taken with those before
    them. Rows that are equal in id and text are taken or left together. An empty table gives empty
    results. A column named ``epoch`` in ``docs`` is replaced; all others stay, whatever their names.
    A very long document is taken whole or not at all.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    keys = ["domain", "lang", "source"]
    at = F.xxhash64(F.lit(seed), "epoch", "hash")
    in_range = F.shiftrightunsigned("at", 64 - RANGES.bit_length() + 1).cast("int")
    kept = [c for c in docs.columns if c != "epoch"]
    # The rows travel as one column, so that names of theirs can't meet those of the plan.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), domain_of(F.col("source"), table).alias("domain"), F.col("lang"), F.col("source"), F.xxhash64("doc_id", "text").alias("hash"))
    small = docs.select(domain_of(F.col("source"), table).alias("domain"), "lang", "source", F.xxhash64("doc_id", "text").alias("hash"), tokens(F.col("text")).alias("t"))
    small = scratch.table(small.groupBy(*keys, "hash").agg(F.sum("t").alias("t")), "tokens")
    supply = small.groupBy(*keys).agg(F.sum("t").alias("tokens"))
    if budget is None:
        budget = int((supply.agg(F.sum("tokens")).first()[0] or 0) * BUDGET_SHARE)
    leaves = scratch.table(budgets(supply, float(budget), epochs, domains, langs, sources or {}), "leaves")
    paid = leaves.select(*keys, "budget")
    every = F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))
    placed = small.select(*keys, "hash", "t", every.alias("epoch")).withColumn("at", at).withColumn("range", in_range)
    sums = placed.groupBy(*keys, "epoch", "range").agg(F.sum("t").alias("sum"))
    over = Window.partitionBy(*keys).orderBy("epoch", "range").rowsBetween(Window.unboundedPreceding, -1)
    sums = null_safe_join(sums.withColumn("base", F.coalesce(F.sum("sum").over(over), F.lit(0))), paid, keys)
    # The first range that a leaf cannot pay for whole, if there is one.
    last = sums.filter("base + sum > budget").groupBy(*keys).agg(F.min(F.struct("epoch", "range", "base", "budget")).alias("end"))
    last = scratch.table(last, "ends")
    inside = null_safe_join(placed, broadcast_if_small(last), keys).filter("epoch = end.epoch and range = end.range")
    within = Window.partitionBy(*keys).orderBy("at", "hash").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("sum", F.col("end.base") + F.sum("t").over(within)).filter("sum <= end.budget")
    cut = inside.groupBy(*keys).agg(F.max(F.struct("at", "hash")).alias("cut"))
    ends = scratch.table(null_safe_join(null_safe_join(paid.select(*keys), last, keys, "left"), cut, keys, "left").select(*keys, F.col("end.epoch").alias("last"), F.col("end.range").alias("last_range"), "cut"), "cuts")
    scratch.drop("tokens", "ends")
    marked = null_safe_join(rows, broadcast_if_small(ends), keys)
    marked = marked.withColumn("epoch", every).withColumn("at", at).withColumn("range", in_range)
    before = F.col("last").isNull() | (F.col("epoch") < F.col("last"))
    ending = (F.col("epoch") == F.col("last")) & ((F.col("range") < F.col("last_range")) | ((F.col("range") == F.col("last_range")) & (F.struct("at", "hash") <= F.col("cut"))))
    return marked.filter(before | ending).select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "epoch"), leaves


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents taken, in tokens of the tokenizer that packing uses."""
    bound_batches(spark)
    return mix(documents(spark, sf_dir), tokens=token_counts(default_tokenizer()))[0].select("doc_id", "lang", "source", "epoch")
