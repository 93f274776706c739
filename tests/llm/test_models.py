import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm import language_id, mixing, quality_model, tokens
from nearfield.llm.common import documents


def test_language_accuracy_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = language_id.op1_language_id(spark, sf).join(documents(spark, sf).select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out")
    assert held.count() > 150 and held.filter("lang_pred = lang").count() / held.count() > 0.97
    assert got.filter("score < 0 or score > 1").count() == 0


def test_language_of_odd_texts(spark, docs, rows, with_repeats, no_docs):
    train = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "en"), ("x", None)] * 5)], "doc_id long, text string, lang string")
    model = language_id.fit(train)
    assert model.langs == ["de", "en"]
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    for d, t, *_ in rows:
        letters = any(unicodedata.category(c)[0] == "L" for c in t or "")
        assert (got[d].lang_pred == "und") == (not letters) and 0 <= got[d].score <= 1
    assert language_id.predict(with_repeats, model).count() == with_repeats.count()
    assert language_id.predict(no_docs, model).count() == 0
    unknown = spark.createDataFrame([(1, "die dogs katzen"), (2, "the cats"), (3, "undundund")], "doc_id long, text string")
    assert [r.lang_pred for r in language_id.predict(unknown, model).orderBy("doc_id").collect()][1:] == ["en", "de"]
    nothing = language_id.fit(train.filter("doc_id < 0"))
    assert {r.lang_pred for r in language_id.predict(unknown, nothing).collect()} == {"und"}
    assert spark.createDataFrame([(None,)], "doc_id long").select(language_id.held_out()).first()[0] is False


def test_letters_are_unicode_letters(spark):
    texts = ["½ ² ① Ⅷ", "٣ 12 _", "x½y", "ªº", "一二", "", None, "\u0301", "e\u0301"]
    model = language_id.fit(spark.createDataFrame([(1, "x y e", "en"), (2, "一 ª º", "zh")], "doc_id long, text string, lang string"))
    got = language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.lang_pred == "und" for r in got] == [not any(unicodedata.category(c)[0] == "L" for c in t or "") for t in texts]
    every = "".join(map(chr, (c for c in range(1 << 17) if not 0xD800 <= c < 0xE000)))
    assert "".join(language_id.LETTERS.findall(every)) == "".join(c for c in every if unicodedata.category(c)[0] == "L")


def brute_languages(train: list[tuple], texts: list) -> list[tuple]:
    """Predictions of a plain model of all words and n-grams of ``train(text, lang)``."""
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())  # noqa: E731  of texts without other numbers
    langs = sorted({lang for _, lang in train})
    counts: list[dict] = [{} for _ in range(6)]
    for text, lang in train:
        for w in words(text):
            m = f"<{w}>"
            for k, gram in [(0, w)] + [(k, m[i : i + k]) for k in range(1, 6) for i in range(len(m) - k + 1)]:
                counts[k].setdefault(gram, dict.fromkeys(langs, 0))[lang] += 1
    totals = [{x: 1 + sum(c[x] for c in table.values()) for x in langs} for table in counts]
    logs = [{g: np.array([math.log((max(c[x], 0) + 0.5) / totals[k][x]) for x in langs]) for g, c in table.items()} for k, table in enumerate(counts)]

    def score(w):
        if w in logs[0]:
            return logs[0][w]
        m = f"<{w}>"
        for k in range(5, 0, -1):
            found = [logs[k][m[i : i + k]] for i in range(len(m) - k + 1) if m[i : i + k] in logs[k]]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(len(langs))

    out = []
    for t in texts:
        own = [score(w) for w in words(t)]
        if not own:
            out.append(("und", 0.0))
            continue
        sums = np.sum(own, axis=0) * min(1, 50 / len(own))
        odds = np.exp(sums - sums.max())
        out.append((langs[int(odds.argmax())], float(odds.max() / odds.sum())))
    return out


def test_languages_match_brute_force(spark, corpus, tmp_path):
    rows = [(r.doc_id, r.text, r.lang) for r in documents(spark, corpus).collect()]
    rows = [(d, (t or "")[:400], lang if d % 9 else None) for d, t, lang in rows] + [(9001, "zzz qqqq", "en"), (9002, None, "de"), (9003, "the der les el", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in language_id.op1_language_id(spark, str(tmp_path)).collect()}
    held = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d, *_ in rows}
    expected = brute_languages([(t, lang) for d, t, lang in rows if lang is not None and t is not None and not held[d]], [t for _, t, _ in rows])
    for (d, *_), (lang, score) in zip(rows, expected, strict=True):
        assert got[d].held_out == held[d] and got[d].lang_pred == lang and got[d].score == pytest.approx(score, abs=1e-3)


def test_backoff_is_word_first():
    vec = lambda *x: np.array(x, np.float32)
    rows = np.array([vec(-1, -9), vec(-5, -1), vec(-2, -1), vec(-4, -1)])
    model = language_id.Model(["a", "b"], [{"cat": 0}, {"t": 1}, {}, {"<ca": 2, "cat": 3}, {}, {}], rows)
    assert model.score("cat").tolist() == [-1, -9] and model.score("cats").tolist() == [-3, -1] and model.score("tt").tolist() == [-5, -1] and model.score("zz").tolist() == [0, 0]


def quality_rows():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(300)]
    rows, labels = [], []
    for k in range(400):
        own = rng.choices(words, k=rng.randint(20, 200))
        bad = k % 5 == 0
        rows.append((k, " ".join(w.upper() + "!!" for w in own) if bad else " ".join(own).capitalize() + "."))
        if k % 2 == 0:
            labels.append((k, 0 if bad else 1))
    return rows, labels


def test_quality_keeps_clean_and_rejects_junk(spark, no_docs, with_repeats):
    rows, labels = quality_rows()
    extra = [(1000, None), (1001, ""), (None, rows[1][1])]
    docs = spark.createDataFrame([(*r, "x", 1.5, "g", "r") for r in rows + extra], "doc_id long, text string, key string, log_weight double, hash string, row string")
    marks = spark.createDataFrame([*labels, (None, 1), (7777, 1), (2, None)], "doc_id long, quality int")
    drawn, scores = quality_model.resample(docs, marks)
    assert drawn.columns == docs.columns and {(r.key, r.log_weight, r.hash, r.row) for r in drawn.collect()} == {("x", 1.5, "g", "r")}
    kept = {r.doc_id for r in drawn.collect()}
    good = {k for k in range(400) if k % 5} | {None}
    assert len(good & kept) >= 0.98 * len(good) and len(kept - good) <= 0.05 * 80
    assert {r.doc_id for r in scores.filter("kept").collect()} == kept and scores.count() == len(rows) + 3
    few = quality_model.resample(docs, marks, k=25)[0]
    assert few.count() == 25
    assert quality_model.resample(no_docs, marks)[0].count() == 0
    unlabelled = quality_model.resample(with_repeats, marks.limit(0))[0]
    assert unlabelled.count() == with_repeats.filter(F.col("text").rlike(r"\S")).count()


def test_weights_and_draw_match_brute_force(spark, corpus):
    """Counts of hashed words and pairs, the ratio of the two models, and the greatest keys, recomputed plainly."""
    from xxhash import xxh32_intdigest

    labels = {r.doc_id: r.quality for r in quality_model.labels_table(spark, corpus).collect()}
    rows = [(r.doc_id, r.text) for r in documents(spark, corpus).collect()] + [(9001, None), (9002, " "), (9003, "one"), (9004, "one")]
    drawn, scores = quality_model.resample(spark.createDataFrame(rows, "doc_id long, text string"), quality_model.labels_table(spark, corpus))

    def grams(t):
        h = [xxh32_intdigest(w) for w in re.findall(r"\w+|[^\w\s]+", (t or "").lower())]
        return [(1, x % 16384) for x in h] + [(2, ((x * 0x9E3779B1 + y * 0x85EBCA77 + (1 << 63)) % (1 << 64) - (1 << 63) >> 12) % 16384) for x, y in zip(h, h[1:], strict=False)]

    raw, target = Counter(), Counter()
    for d, t in rows:
        raw.update(grams(t))
        if labels.get(d) == 1:
            target.update(grams(t))
    total = {k: [sum(n for g, n in c.items() if g[0] == k) for c in (raw, target)] for k in (1, 2)}
    ratio = {g: math.log((target[g] + 20) / (n * total[g[0]][1] / total[g[0]][0] + 20)) for g, n in raw.items()}
    got = {r.doc_id: r for r in scores.collect()}
    for d, t in rows:
        assert (got[d].log_weight is None) == (not grams(t)) and (not grams(t) or got[d].log_weight == pytest.approx(sum(ratio[g] for g in grams(t)), abs=1e-6)), d
    noise = {r.doc_id: r.g for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", quality_model.gumbel(quality_model.SEED, "doc_id", F.xxhash64("text")).alias("g")).collect()}
    n = sum(bool(grams(t)) for _, t in rows)
    k = round(n * sum(labels.values()) / len(labels))
    first = sorted((d for d, t in rows if grams(t)), key=lambda d: -(got[d].log_weight + noise[d]))[:k]
    assert {r.doc_id for r in drawn.collect()} == set(first) == {d for d, r in got.items() if r.kept}
    other = {r.doc_id for r in quality_model.resample(spark.createDataFrame(rows, "doc_id long, text string"), quality_model.labels_table(spark, corpus), k=k // 2, seed=77)[0].collect()}
    same = {r.doc_id for r in quality_model.resample(spark.createDataFrame(rows, "doc_id long, text string"), quality_model.labels_table(spark, corpus), k=k // 2)[0].collect()}
    assert len(other) == len(same) == k // 2 and other != same


def test_inclusion_follows_the_weights(spark):
    """Gumbel top-1 takes each of four documents as often as its share of the weights; the noise is a standard Gumbel's."""
    weights = [1.0, 2.0, 3.0, 4.0]
    df = spark.range(4000).select(F.col("id").alias("draw"), F.explode(F.array(*map(F.lit, range(4)))).alias("doc_id"))
    logs = F.element_at(F.array(*[F.lit(math.log(w)) for w in weights]), F.col("doc_id") + 1)
    keys = df.withColumn("noise", quality_model.gumbel(7, "draw", "doc_id")).withColumn("key", logs + F.col("noise"))
    mean, var = keys.agg(F.mean("noise"), F.variance("noise")).first()
    assert mean == pytest.approx(0.5772, abs=0.05) and var == pytest.approx(math.pi**2 / 6, abs=0.1)
    won = Counter(r[0] for r in keys.groupBy("draw").agg(F.max_by("doc_id", "key")).select(F.col("max_by(doc_id, key)")).collect())
    assert all(won[k] / 4000 == pytest.approx(w / 10, abs=0.025) for k, w in enumerate(weights))
    assert quality_model.top_k_floor(keys.select("key"), 0) == math.inf and quality_model.top_k_floor(keys.select("key"), 10**6) == -math.inf


@pytest.mark.parametrize("k", [1, 7, 500, 999, 1000])
def test_kth_largest(spark, k):
    rng = random.Random(k)
    values = [rng.choice([1.5, rng.random() * 1e6, -rng.random(), 1e-9 * rng.random()]) for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    assert quality_model.kth_largest(df, "v", k, last=5) == sorted(values, reverse=True)[k - 1]


def brute_fill(weights, caps, budget):
    """Share out by weight, again and again, to those that are not full."""
    given = [0.0] * len(weights)
    for level in (1, 0):
        open_ = {i for i in range(len(weights)) if (weights[i] > 0) == bool(level)}
        while open_ and budget - sum(given) > 1e-9:
            rest, w = budget - sum(given), sum(weights[i] if level else 1.0 for i in open_)
            full = False
            for i in sorted(open_):
                add = rest * (weights[i] if level else 1.0) / w
                if given[i] + add >= caps[i] - 1e-12:
                    full = True
                    given[i] = caps[i]
                    open_.discard(i)
                    break
            if not full:
                for i in open_:
                    given[i] += rest * (weights[i] if level else 1.0) / w
                break
    return given


@pytest.mark.parametrize("seed", range(4))
def test_fill(spark, seed):
    rng = random.Random(seed)
    nodes = [("p", f"n{k}", rng.choice([0.0, 1.0, 2.0, 5.0]), float(rng.randint(0, 100))) for k in range(8)]
    budget = float(rng.randint(1, 500))
    df = spark.createDataFrame(nodes, "p string, n string, w double, cap double")
    got = {r.n: r.given for r in mixing.fill(df, ["p"], "n", "cap", "w", F.lit(budget), "given").collect()}
    total = min(budget, sum(n[3] for n in nodes))
    assert sum(got.values()) == pytest.approx(total) and all(got[n[1]] <= n[3] + 1e-9 for n in nodes)
    on = [n for n in nodes if n[2] > 0]
    level = [got[n[1]] / n[2] for n in on if got[n[1]] < n[3] - 1e-9]
    assert not level or max(level) - min(level) < 1e-6 and all(got[n[1]] / n[2] <= level[0] + 1e-6 for n in on)
    assert all(got[n[1]] == 0 for n in nodes if n[2] == 0) or not level
    assert [got[n[1]] for n in nodes] == pytest.approx(brute_fill([n[2] for n in nodes], [n[3] for n in nodes], budget), abs=1e-6)


@pytest.mark.parametrize("seed", range(3))
def test_budgets_of_the_whole_tree(spark, seed):
    """Shortages go to siblings first, at each of the three levels."""
    rng = random.Random(seed)
    supply = [(d, lang, f"s{k}", rng.randint(0, 400)) for d in ("web", "reference", "other") for lang in ("en", "de", "it", None) for k in range(rng.randint(1, 3))]
    weights, named = {"web": 3.0, "reference": 0.0}, {"en": 2.0, "de": 1.0}
    sources, budget, epochs = {"s0": 2.0, "s1": 0.0}, float(rng.randint(500, 9000)), 2
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(spark.createDataFrame(supply, "domain string, lang string, source string, tokens long"), budget, epochs, weights, named, sources).collect()}
    cap = lambda *key: sum(epochs * n for d, x, s, n in supply if (d, x, s)[: len(key)] == key)
    ds = sorted({d for d, *_ in supply})
    of_domain = dict(zip(ds, brute_fill([weights.get(d, 1.0) for d in ds], [cap(d) for d in ds], budget), strict=True))
    for d in ds:
        langs = sorted({x for e, x, *_ in supply if e == d}, key=str)
        tokens, w = sum(cap(d, x) for x in langs if named.get(x, 0) > 0), sum(named[x] for x in langs if named.get(x, 0) > 0)
        own = [named[x] if x in named else cap(d, x) * (w / tokens if tokens else 1.0) for x in langs]
        for x, given in zip(langs, brute_fill(own, [cap(d, x) for x in langs], of_domain[d]), strict=True):
            leaves = sorted(s for e, y, s, _ in supply if (e, y) == (d, x))
            for s, b in zip(leaves, brute_fill([sources.get(s, 1.0) for s in leaves], [cap(d, x, s) for s in leaves], given), strict=True):
                assert got[d, x, s] == pytest.approx(b, abs=1.01), (d, x, s)


def test_mixture_matches_its_budgets(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["en", "en", "en", "de", "fr", None]), rng.choice(["src1", "src2", "src3", None])) for k in range(600)]
    docs = spark.createDataFrame([(*r, 1, "h") for r in rows], "doc_id long, text string, lang string, source string, epoch int, range string").repartition(5)
    taken, leaves = mixing.mix(docs, budget=6000, epochs=3)
    leaf = {(r.domain, r.lang, r.source): r for r in leaves.collect()}
    got = taken.withColumn("domain", mixing.domain_of(F.col("source"), mixing.DOMAINS)).withColumn("t", mixing.default_tokens(F.col("text"))).collect()
    spent, times = dict.fromkeys(leaf, 0), {}
    for r in got:
        spent[r.domain, r.lang, r.source] += r.t
        times.setdefault((r.doc_id, r.epoch), 0)
        times[r.doc_id, r.epoch] += 1
    assert set(times.values()) == {1} and max(e for _, e in times) <= 2
    assert sum(r.budget for r in leaf.values()) == pytest.approx(6000, abs=len(leaf))
    for key, r in leaf.items():
        assert 0 <= r.budget - spent[key] < 30 or spent[key] == 3 * r.tokens, key
    for d, e in times:  # a later epoch begins only when the earlier is used up
        assert e == 0 or (d, e - 1) in times
    # The prefix itself, from the same hashes.
    order = docs.withColumn("h", F.xxhash64("doc_id", "text")).withColumn("e", F.explode(F.array(*map(F.lit, range(3))))).withColumn("at", F.xxhash64(F.lit(mixing.SEED), "e", "h"))
    order = order.select("doc_id", "e", "at", "h", mixing.domain_of(F.col("source"), mixing.DOMAINS).alias("d"), "lang", "source", mixing.default_tokens(F.col("text")).alias("t")).collect()
    expected = set()
    for key in leaf:
        own = sorted((r for r in order if (r.d, r.lang, r.source) == key), key=lambda r: (r.e, (r["at"] % (1 << 64)) >> 54, r["at"], r.h))
        total = 0
        for r in own:
            total += r.t
            if total > leaf[key].budget:
                break
            expected.add((r.doc_id, r.e))
    assert set(times) == expected
    again = mixing.mix(docs.repartition(2), budget=6000, epochs=3)[0]
    assert sorted((r.doc_id, r.epoch) for r in again.collect()) == sorted(times)


def test_mixture_keeps_null_and_unnamed_languages(spark):
    """Production weights and budget: languages without a weight of their own come in proportion to their tokens."""
    langs = ["en"] * 4 + ["de", "fr", "es", "it", None, "xx"]
    rows = [(k, "w " * (10 + k % 7), langs[k % 10] if k < 3000 else (None if k % 2 else "it"), "src1" if k < 1500 else "src2" if k < 3000 else "src4") for k in range(3200)]
    rows = [(d, t, lang, "src3" if s == "src4" and d % 4 > 1 else s) for d, t, lang, s in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    taken, leaves = mixing.mix(docs)
    size = {r.lang: r.n for r in docs.groupBy("lang").agg(F.sum(mixing.default_tokens(F.col("text"))).alias("n")).collect()}
    got = {r.lang: r.n for r in taken.groupBy("lang").agg(F.sum(mixing.default_tokens(F.col("text"))).alias("n")).collect()}
    assert set(got) == {"en", "de", "fr", "es", "it", None, "xx"} and all(0.5 < got[x] / size[x] < 1.5 for x in ("it", None, "xx"))
    assert sum(got.values()) == pytest.approx(0.9 * sum(size.values()), abs=20 * leaves.count())
    alone = mixing.mix(docs.filter("lang is null or lang = 'it'"))[0]
    assert {r.lang for r in alone.select("lang").distinct().collect()} == {"it", None}
    off = mixing.mix(docs, langs={"en": 1.0, "de": 0.0})[0]
    assert off.filter("lang = 'de'").count() == 0 and off.filter("lang is null").count() > 0


def test_mixture_in_tokens_with_clashing_names(spark):
    """The production count of tokens, a table of domains, and columns named as the plan's own."""
    code = tokens.Encoder(tokens.default_tokenizer())
    rows = [(k, None if k % 11 == 0 else "word  other, thing! " * (k % 7), "en", f"s{k % 3}", "d", 5, "x", 1) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, domain string, hash int, row string, at int")
    taken, leaves = mixing.mix(docs, tokens=tokens.token_counts(tokens.default_tokenizer()), table={"a": ("s0",), "b": ("s1",)})
    assert taken.columns == [*docs.columns, "epoch"] and {(r.domain, r.hash, r.row, r["at"]) for r in taken.collect()} == {("d", 5, "x", 1)}
    size = {f"s{m}": sum(len(code.encode(t or "")) // 4 + 1 for d, t, *_ in rows if d % 3 == m) for m in range(3)}
    assert {(r.domain, r.source): r.tokens for r in leaves.collect()} == {("a", "s0"): size["s0"], ("b", "s1"): size["s1"], (mixing.OTHER, "s2"): size["s2"]}


def test_mixture_of_odd_tables(docs, with_repeats, no_docs):
    assert mixing.mix(no_docs)[0].count() == 0
    every = mixing.mix(with_repeats, budget=10**9, epochs=2, domains={}, langs={})[0]
    assert every.count() == 2 * with_repeats.count() and set(every.columns) == set(with_repeats.columns)
    assert mixing.mix(docs, budget=0)[0].filter(mixing.default_tokens(F.col("text")) > 0).count() == 0
