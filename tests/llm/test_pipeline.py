"""The quality classifier against a plain model, and the pipeline against its parts."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from gondola.llm import quality
from gondola.llm.quality_queries import op5_quality
from test_dedup import brute
from test_spans import personal

SF = "/root/testdata/sf0.001"


def plain_model(texts):
    """Interpolated modified Kneser-Ney over bytes, straight from its definition."""
    counts = {quality.ORDER: Counter(g for t in texts for g in quality.grams(t).tolist())}
    for level in range(quality.ORDER - 1, 0, -1):
        counts[level] = Counter(g & (1 << 8 * level) - 1 for g in counts[level + 1])
    contexts = {m: defaultdict(list) for m in counts}
    discounts = {}
    for m, table in counts.items():
        for g, c in table.items():
            contexts[m][g >> 8].append(c)
        n = [sum(c == i for c in table.values()) for i in range(5)]
        if 0 in n[1:4]:
            discounts[m] = [0, 0.5, 0.5, 0.5]
        else:
            y = n[1] / (n[1] + 2 * n[2])
            discounts[m] = [0, *(max(0.0, i - (i + 1) * y * n[i + 1] / n[i]) for i in (1, 2, 3))]

    def p(g, m):
        if m == 0:
            return 1 / 256
        lower = p(g & (1 << 8 * (m - 1)) - 1, m - 1)
        own = contexts[m].get(g >> 8)
        if not own:
            return lower
        c, d = counts[m].get(g, 0), discounts[m]
        back = sum(d[min(x, 3)] for x in own) / sum(own)
        return max(c - d[min(c, 3)], 0) / sum(own) + back * lower

    return p


def test_probabilities_equal_the_plain_model(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    p = plain_model(texts[:25])
    seen = Counter(g for t in texts[:25] for g in quality.grams(t).tolist())
    every = {g for t in texts for g in quality.grams(t).tolist()}
    asked = spark.createDataFrame([(g, seen.get(g, 0)) for g in every], "gram long, n long")
    for r in quality.probabilities(asked).collect():
        assert math.isclose(r.cost, -math.log(p(r.gram, quality.ORDER)), rel_tol=1e-9)
    by_context = defaultdict(float)
    some = {g >> 8 for g in list(every)[:5]}
    for h in some:
        by_context[h] = sum(p(h << 8 | w, quality.ORDER) for w in range(256))
    assert all(abs(s - 1) < 1e-9 for s in by_context.values())


def test_junk_goes_and_clean_documents_stay(spark):
    judged = op5_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = judged.join(labels, "doc_id").collect()
    clean = [r.kept for r in rows if r.quality == 1]
    junk = [r.kept for r in rows if r.quality == 0]
    assert all(clean) and np.mean(junk) < 0.4
    assert judged.count() == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()


def test_little_junk_stays(spark):
    judged = op5_quality(spark, "/root/testdata/sf0.1").select("doc_id", "kept")
    rows = judged.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    clean = [r.kept for r in rows if r.quality == 1]
    junk = [r.kept for r in rows if r.quality == 0]
    print(f"junk kept {sum(junk)} of {len(junk)}, clean lost {len(clean) - sum(clean)} of {len(clean)}")
    assert np.mean(junk) < 0.1 and np.mean(clean) > 0.995


@pytest.mark.parametrize("label", [(1, 0), (0, 0), (None, None)])
def test_quality_hard_rows(spark, hard_docs, no_docs, label):
    rows, df = hard_docs
    labels = spark.createDataFrame([(r[0], *label) for r in rows], "doc_id long, quality int, toxic int")
    judged = quality.judge(df, labels).collect()
    assert len(judged) == len(rows)
    assert all(r.kept for r in judged if not r.doc.text)
    if label != (1, 0):
        assert all(r.kept for r in judged)
    assert quality.keep_good(df, labels).columns == df.columns
    assert quality.keep_good(no_docs, labels.limit(0)).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.STAGES[0][1](spark, docs, SF).cache()
    assert good.columns == docs.columns and 0 < good.count() <= docs.count()
    single = corpus_pipeline.STAGES[1][1](spark, good, SF).cache()
    want = brute([(r.doc_id, r.text) for r in good.collect()], 5, 80)
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    masked = corpus_pipeline.STAGES[2][1](spark, single, SF).cache()
    assert masked.columns == docs.columns and masked.count() == single.count()
    assert not any(personal(r.text) for r in masked.collect())
    packed = corpus_pipeline.STAGES[3][1](spark, masked, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in masked.collect()}


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "pii", "packing"]

