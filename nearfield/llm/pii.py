"""Personal data by weak supervision, in DataFrame functions only.

Candidates are all spans of strict form, and looser ones: spoken addresses, national telephone
numbers, IPv6 addresses, numbers of a card's length, and names. Three labelers vote on each: one by
regular expression, whether it is well formed; a gazetteer, whether a list knows its head or tail;
one by context, whether a cue stands before it. The votes of all candidates are counted by pattern.
From them expectation-maximisation estimates how reliable each labeler is, and gives every pattern
a soft label. On these a naive Bayes classifier is trained over what a span looks like, not over
the votes: its head, its length, its separators, its neighbours. It decides which loose candidates
are added; spans of strict form always stay.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import Scratch, documents, text_or_empty
from nearfield.llm.spans import contains_any, count_kind, joined, let, running, spans

#: The first four have a strict form, whose spans are the base.
KINDS = ("email", "ip", "card", "phone", "name")
BASE_KINDS = KINDS[:4]
# A start is tried only where the run of letters begins or the last match ended; elsewhere it could not match either.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Loose candidates: spoken addresses, IPv6, national numbers and those with 00, names with a title or of two words.
SPOKEN = r"\b[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z0-9-]{1,63}+)++"
_HEX = "[0-9A-Fa-f]{1,4}"
IPV6 = rf"(?<![0-9A-Za-z:])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}:{_HEX}(?::{_HEX}){{0,5}})(?![0-9A-Za-z:])"
NATIONAL = r"(?<![0-9A-Za-z+.,(-])(?:00[1-9][0-9]{0,2}[ .-])?\(?[0-9]{2,5}\)?[ .-]{1,2}[0-9]{3,4}[ .-][0-9]{3,5}(?![0-9A-Za-z-])"
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora"
_CAPITAL = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{1,24}+"
NAME = rf"(?<![\w])(?:(?:{TITLES})\.? )?{_CAPITAL}(?:[ -]{_CAPITAL}){{1,2}}+(?![\w@])"
#: Words that announce a kind of span when they end at most ``BEFORE`` characters before it.
CUES = {
    "email": "mail|contact|write|reach",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|credit|debit|pay|account",
    "phone": "phone|tel|call|mobile|fax|sms|contact",
    "name": "name|contact|dear|sincerely|regards|signed|author|patient|customer",
}
BEFORE = 32
# The gazetteer: top-level domains, issuers' first digits, countries' calling codes, given names.
DOMAINS = "com|org|net|edu|gov|io|info|de|fr|es|uk|eu|it|nl|pl|ch|at|be|ca|us|au|br|in|jp|cn|ru"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|3[068]|6011|65|35"
CALLING = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
GIVEN = (
    "Anna|Maria|Laura|Julia|Sarah|Emma|Sophie|Marie|Lucia|Carmen|Elena|Alice|Claire|Nina|Eva|Clara|Susan|Linda|Karen|Lisa|Helen|Nancy|Emily|Jane|Mary|Alexander|Thomas|Michael|Peter|Paul|Daniel|David|Martin|"
    "Andreas|Stefan|Hans|Jean|Pierre|Louis|Antoine|Carlos|Jose|Juan|Luis|Miguel|Pablo|John|James|Robert|William|Richard|Charles|George|Mark|Steven|Kevin|Brian|Adam|Simon|Felix|Max|Jonas|Lukas|Hugo|Leo"
)
#: Rounds of expectation-maximisation.
ROUNDS = 50
#: What a span looks like: features of the final classifier.
LOOKS = ("head", "size", "marks", "left")
VOTES = ("form", "listed", "cued")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _octet(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+(?=.)", "")
    return (F.length(bare) <= 3) & (bare.try_cast("int") <= 255)


def _is_card(match: Column) -> Column:
    digits = _digits(match)
    return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)


#: The strict forms of the base.
STRICT = {
    "email": lambda m: F.contains(m, F.lit("@")),
    "ip": lambda m: F.contains(m, F.lit(".")) & F.forall(F.split(m, r"\."), _octet),
    "card": _is_card,
    "phone": lambda m: F.startswith(m, F.lit("+")) & F.length(_digits(m)).between(9, 15),
    "name": lambda m: F.lit(False),
}
#: The first labeler: strict spans, and loose ones that leave nothing to guess.
WELL_FORMED = {
    "email": lambda m: m.rlike(r"(?:\(at\)|\[at\]).*(?:\(dot\)|\[dot\]|\.)"),
    "ip": lambda m: m.rlike("^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$"),
    "card": lambda m: F.lit(False),
    "phone": lambda m: F.length(_digits(m)).between(9, 15) & m.rlike(r"^(?:00|\(|0)"),
    "name": lambda m: m.rlike(rf"^(?:{TITLES})\b"),
}
GAZETTEER = {
    "email": lambda m: m.rlike(rf"(?i)(?:\.|\]|\)|dot) ?(?:{DOMAINS})$"),
    "ip": lambda m: ~m.rlike(r"^(?:0+|127|22[4-9]|2[3-5][0-9])\.") & ~m.rlike("(?i)^(?:0|f[ef])"),
    "card": lambda m: _digits(m).rlike(f"^(?:{ISSUERS})"),
    "phone": lambda m: F.regexp_replace(_digits(m), "^00", "").rlike(f"^(?:{CALLING}|0[1-9])"),
    "name": lambda m: m.rlike(rf"\b(?:{GIVEN})\b"),
}
#: The head that the final classifier sees.
HEAD = {
    "email": lambda m: F.lower(F.regexp_extract(m, rf"(?i)(?:\.|\]|\)|dot) ?({DOMAINS})$", 1)),
    "ip": lambda m: F.when(F.contains(m, F.lit(":")), "6").otherwise("4"),
    "card": lambda m: F.regexp_extract(_digits(m), f"^({ISSUERS})", 1),
    "phone": lambda m: F.regexp_extract(m, r"^(?:\+|00|0|\()", 0),
    "name": lambda m: F.regexp_extract(m, rf"\b({TITLES})\b", 1),
}


def _candidates(text: Column) -> dict[str, Column]:
    """Loosely shaped spans of each kind; those of strict form are among them. Two patterns of a kind may overlap; the strict one goes first."""
    digits = text.rlike("[0-9](?:[ -]?[0-9]){6}")
    find = lambda pattern, present: spans(text, pattern, present, BEFORE)
    return {
        "email": F.concat(find(EMAIL, contains_any(text, "@")), find(SPOKEN, contains_any(text, "(at)", "[at]", " dot "))),
        "ip": F.concat(find(IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]")), find(IPV6, text.rlike("[0-9A-Fa-f]::[0-9A-Fa-f]|(?:[0-9A-Fa-f]{1,4}:){7}"))),
        "card": F.filter(find(CARD, digits), lambda s: F.length(_digits(s["match"])).between(13, 19)),
        "phone": F.concat(find(PHONE, contains_any(text, "+")), find(NATIONAL, text.rlike("[0-9]{2}[).]?[ .-]{1,2}[0-9]{3}"))),
        "name": find(NAME, text.rlike(rf"\b(?:{TITLES})\.? [A-ZÀ-Þ]|\b(?:{GIVEN})[ -][A-ZÀ-Þ]")),
    }


CANDIDATE = "array<struct<kind:string,start:int,end:int,strict:boolean,key:string>>"


def _votes(kind: str, found: Column) -> Column:
    """``kind, start, end, strict, key`` of each candidate; ``key`` has the votes and looks that the counts go by."""

    def vote(s: Column) -> Column:
        m, before = s["match"], s["before"]
        strict = F.coalesce(STRICT[kind](m), F.lit(False))
        bit = lambda c: F.coalesce(c, F.lit(False)).cast("int").cast("string")
        size = F.least(F.length(m) if kind in ("email", "name") else F.length(F.regexp_replace(m, "[^0-9A-Fa-f]", "")), F.lit(40))
        size = F.floor(size / 4) if kind in ("email", "name") else size
        marks = F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace(m, r"[\p{L}\p{N}]", ""), ""))), "")
        # A letter, a digit, a space, a mark of ASCII as it is, or any other: so keys are few, whatever texts hold.
        left = F.when(before == "", "^").otherwise(F.right(before, F.lit(1)))
        for shape, name in ((r"\p{L}", "a"), (r"\p{N}", "9"), (r"\s", "_"), (r"[^\x21-\x7E]", "*")):
            left = F.regexp_replace(left, shape, name)
        cued = F.lower(before).rlike(rf"\b(?:{CUES[kind]})")
        votes = [bit(strict | WELL_FORMED[kind](m)), bit(GAZETTEER[kind](m)), bit(cued)]
        key = F.concat_ws("\u0001", F.lit(kind), *votes, HEAD[kind](m), size.cast("string"), F.substr(marks, F.lit(1), F.lit(4)), left)
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), strict.alias("strict"), key.alias("key"))

    return F.transform(found, vote)


def estimate(counts: dict[tuple[int, int, int], float], rounds: int = ROUNDS) -> dict[tuple[int, int, int], float]:
    """The chance that a candidate is true, by its votes. ``counts`` has at most eight patterns.

    Expectation-maximisation of a latent class with votes that are independent given the class; it
    begins with labelers that are right four times in five, and keeps every rate off 0 and 1.
    """
    right, wrong, share = [0.8] * 3, [0.2] * 3, 0.5
    chance: dict[tuple[int, int, int], float] = {}
    for _ in range(rounds):
        for v in counts:
            p = [share, 1 - share]
            for k, (a, b) in enumerate(zip(right, wrong, strict=True)):
                p = [p[0] * (a if v[k] else 1 - a), p[1] * (b if v[k] else 1 - b)]
            chance[v] = p[0] / (p[0] + p[1])
        total, true = sum(counts.values()), sum(n * chance[v] for v, n in counts.items())
        share = (true + 1) / (total + 2)
        for k in range(3):
            right[k] = (sum(n * chance[v] for v, n in counts.items() if v[k]) + 1.6) / (true + 2)
            wrong[k] = (sum(n * (1 - chance[v]) for v, n in counts.items() if v[k]) + 0.4) / (total - true + 2)
    return chance


def train(rows: list[tuple[str, int]]) -> dict[str, float]:
    """Log odds by key, from keys and their counts: naive Bayes over the looks, on the soft labels that the votes get."""
    odds: dict[str, float] = {}
    split = [(key, key.split("\u0001"), n) for key, n in rows]
    for kind in KINDS:
        own = [(key, tuple(int(x) for x in parts[1:4]), tuple(parts[4:8]), n) for key, parts, n in split if parts[0] == kind]
        if not own:
            continue
        patterns: dict[tuple[int, int, int], float] = defaultdict(float)
        for _, votes, _, n in own:
            patterns[votes] += n
        chance = estimate(dict(patterns))
        weight: dict[tuple, float] = defaultdict(float)
        for _, votes, looks, n in own:
            for y, p in ((1, chance[votes]), (0, 1 - chance[votes])):
                weight[y,] += n * p
                for feature in enumerate(looks):
                    weight[(y, *feature)] += n * p
        values = [len({looks[k] for _, _, looks, _ in own}) for k in range(len(LOOKS))]
        for key, _, looks, _ in own:
            score = math.log((weight[1,] + 1) / (weight[0,] + 1))
            for k, value in enumerate(looks):
                score += math.log((weight[1, k, value] + 1) / (weight[1,] + values[k])) - math.log((weight[0, k, value] + 1) / (weight[0,] + values[k]))
            odds[key] = score
    return odds


def _clear(loose: Column, base: Column) -> Column:
    """Those of ``loose`` that overlap no span of ``base``, in time linear but for the sort."""
    mark = lambda found, own: F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(own).alias("base"), s["kind"].alias("kind")))
    far = (1 << 31) - 1

    def sweep(every: Column) -> Column:
        ends = running(F.transform(every, lambda s: F.when(s["base"], s["end"]).otherwise(0)), lambda a, b: F.greatest(a, b), F.lit(0))
        starts = F.reverse(running(F.reverse(F.transform(every, lambda s: F.when(s["base"], s["start"]).otherwise(far))), lambda a, b: F.least(a, b), F.lit(far)))
        placed = F.zip_with(F.zip_with(every, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"))), starts, lambda x, n: F.struct(x["s"].alias("s"), x["e"].alias("e"), n.alias("n")))
        return F.transform(F.filter(placed, lambda x: ~x["s"]["base"] & (x["e"] <= x["s"]["start"]) & (x["n"] >= x["s"]["end"])), lambda x: F.struct(x["s"]["kind"].alias("kind"), x["s"]["start"].alias("start"), x["s"]["end"].alias("end")))

    return let(F.array_sort(F.concat(mark(loose, False), mark(base, True))), sweep)


def find_personal(docs: DataFrame, threshold: float = 0.0) -> DataFrame:
    """``doc_id, base, added`` for each row of ``docs(doc_id, text)``: spans as arrays of ``order, start, end, kind``.

    ``base`` has all spans of strict form. ``added`` has the other candidates whose log odds exceed
    ``threshold`` and that overlap no base span, as kinds ``email_like`` and so on. A null text
    counts as empty; null and repeated ids are rows like others, and every row counts in the
    estimates; an empty table gives no rows; other columns are ignored. A text's cost is about linear
    in its length and in its number of spans; very long texts are searched whole.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.col("__text")
    rows = docs.select(F.col("doc_id"), text_or_empty().cast("string").alias("__text"))
    rows = rows.select("doc_id", *[c.alias(f"__{k}") for k, c in _candidates(text).items()])
    rows = scratch.table(rows.select("doc_id", F.concat(*[_votes(k, F.col(f"__{k}")) for k in KINDS]).cast(CANDIDATE).alias("votes")), "candidates")
    counts = rows.filter(F.size("votes") > 0).select(F.explode("votes").alias("v")).groupBy("v.key").count()
    odds = train([(r[0], r[1]) for r in counts.collect()])  # a row for each combination of votes and looks, whose values are all of short lists
    good = [k for k, s in sorted(odds.items()) if s > threshold]
    base = F.filter("votes", lambda v: v["strict"])
    rows = rows.select("doc_id", base.alias("base"), F.filter("votes", lambda v: ~v["strict"] & v["key"].isin(good)).alias("loose"))
    order = lambda kind: F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int") - 1
    added = F.when(F.size("loose") > 0, F.array_distinct(_clear(F.col("loose"), F.col("base"))))
    span = lambda v, kind, n: F.struct(n.alias("order"), v["start"].alias("start"), v["end"].alias("end"), kind.alias("kind"))
    return rows.select(
        "doc_id",
        F.transform("base", lambda v: span(v, v["kind"], order(v["kind"]))).alias("base"),
        F.coalesce(F.transform(added, lambda v: span(v, F.concat(v["kind"], F.lit("_like")), order(v["kind"]) + len(KINDS))), F.array().cast("array<struct<order:int,start:int,end:int,kind:string>>")).alias("added"),
    )


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest columns of all spans of personal data in ``documents``."""
    found = find_personal(documents(spark, sf_dir))
    counts = [count_kind(F.col("base"), k).alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base"), False), 256).alias("base_sha256"), joined(F.concat("base", "added"), False).alias("spans"))
