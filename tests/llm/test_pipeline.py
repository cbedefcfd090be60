"""The pipeline: every stage alone and all of them, on the smallest tables and on odd rows."""

import corpus_pipeline
from foreband.llm import jaccard_join, packing, quality, secrets
from tests.llm.test_text_operators import DOCS, documents


def test_stages_take_effect(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet")
    good = corpus_pipeline.keep_good(spark, docs, root).cache()
    scores = quality.classify(docs, spark.read.parquet(f"{root}/labels.parquet"))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in scores.where("predicted = 1").collect()}
    single = corpus_pipeline.drop_near_copies(spark, good, root).cache()
    found = jaccard_join.components(good)
    assert {r.doc_id for r in single.collect()} == {r.doc_id for r in found.where("doc_id = component_id").collect()}
    clean = corpus_pipeline.mask_secrets(spark, single, root).cache()
    assert clean.count() == single.count() and all(not secrets.spans(r.text) or secrets.MASK in r.text for r in clean.collect())
    assert good.columns == single.columns == clean.columns == corpus_pipeline.mix_sources(spark, clean, root).columns == docs.columns


def test_run_packs_what_the_stages_keep(spark, root):
    out = corpus_pipeline.run(spark, root)
    assert out.columns == packing.PIECE.replace(" long", "").replace(" int", "").split(", ") + ["sequence_id", "offset"]
    assert out.count() > 0 and len(corpus_pipeline.STAGES) == 5


def test_stages_on_odd_rows(spark, root):
    rows = [(i, t, "en", s, len(t or ""), "k", 1, 0.5, -1) for i, t, s in documents()]
    odd = spark.createDataFrame(rows, DOCS)
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, odd.limit(0), root).count() == 0, name
    single = corpus_pipeline.drop_near_copies(spark, odd, root)
    assert single.where("doc_id = 90").count() == 1 and single.where("doc_id in (80, 81, 82)").count() == 3
    assert corpus_pipeline.keep_good(spark, odd, root).columns == odd.columns


def test_dedupe_takes_near_copies_from_four_fifths_on(spark, root):
    """Copies between 0.80 and 0.85: appended and removed tails, an inserted passage, scattered edits. One below 0.80 stays."""
    texts = {}
    for i in range(5):
        base = [f"a{i}x{j}" for j in range(600)]
        more = [f"b{i}x{j}" for j in range(600)]
        edited = [more[j] if j % 46 == 20 else w for j, w in enumerate(base)]
        texts[10 * i] = base
        texts[10 * i + 1] = [base + more[:140], base[:490], base[:300] + more[:135] + base[300:], edited, base + more[:180]][i]
    for i in range(5):
        five, four = (similarity(texts[10 * i], texts[10 * i + 1], k) for k in (5, 4))
        assert 0.80 <= five < 0.85 and four < 0.85 or i == 4 and five < 0.80
    rows = [(i, " ".join(t), "en", "s", 1, "k", 1, 0.5, -1) for i, t in texts.items()]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), root)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 10, 20, 30, 40, 41]


def similarity(a, b, k):
    """Jaccard similarity of two word lists over k-word shingles."""
    x, y = ({tuple(t[i : i + k]) for i in range(len(t) - k + 1)} for t in (a, b))
    return len(x & y) / len(x | y)
