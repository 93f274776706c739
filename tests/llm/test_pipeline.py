import brute
import corpus_pipeline
from pyspark.sql import functions as F

from nearfield.llm.common import documents


def test_stages_one_by_one(spark, corpus, tmp_path):
    docs = documents(spark, corpus)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{corpus}/labels.parquet").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "best-fit packing"]
    held = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, corpus)
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        held[name] = (before, docs)
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
    before, after = held["quality classifier"]
    kept = {r.doc_id for r in after.collect()}
    # A draw, not a threshold: documents of a weight near the last drawn may go either way.
    present = {r.doc_id for r in before.select("doc_id").collect()}
    good, bad = ([d in kept for d, q in labels.items() if q == k and d in present] for k in (1, 0))
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad) + 1, (sum(good), len(good), sum(bad), len(bad))
    before, after = held["n-gram Jaccard join"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    sets = {d: brute.shingles(t, 5) for d, t in rows}
    left = {r.doc_id for r in after.collect()}
    linked = lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert not any(linked(a, b) for a in left for b in left if a < b)
    assert all(any(linked(a, b) for b in sets if b != a) for a in set(sets) - left)
    before, after = held["secret scans"]
    assert after.count() == before.count() and all(brute.secrets(r.text)[:3] == (0, 0, 0) and r.n_chars == len(r.text) for r in after.collect())
    before, after = held["mixing sources to target weights"]
    assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()} and after.count() > 0
    before, after = held["best-fit packing"]
    assert after.filter("piece = 0").count() == before.count()


def test_near_duplicates_of_odd_rows(spark, with_repeats):
    got = corpus_pipeline.near_duplicates(spark, with_repeats, "")
    assert got.count() == got.dropDuplicates().count() < with_repeats.count()
    assert corpus_pipeline.near_duplicates(spark, with_repeats.limit(0), "").count() == 0


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    assert out.count() > 0 and corpus_pipeline.ORACLE_SQL is None
