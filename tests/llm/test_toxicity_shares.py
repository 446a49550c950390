"""The toxicity score follows the labels' true shares, however the training sample is capped."""

import numpy as np
from pyspark.sql import functions as F

from trustframe.llm import toxicity
from trustframe.llm.common import table


def _mean(spark, model, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return np.array([r["score"] for r in toxicity.score(docs, model).orderBy("doc_id").collect()])


def test_share_without_signal(spark):
    texts = [f"plain words number {'abcdefghij'[k % 10]} here" for k in range(100)]
    model = toxicity.fit([(t, y) for y in (0, 1) for t in texts], (900, 100))
    assert np.allclose(_mean(spark, model, texts[:5]), 0.1, atol=0.01)


def test_score_stays_when_caps_bind(spark, monkeypatch):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    totals = toxicity.training_totals(docs, labels)
    out = {}
    for cap in (100_000, 400):
        monkeypatch.setattr(toxicity, "MAX_CLEAN", cap)
        rows = toxicity.training_rows(docs, labels)
        assert len(rows) == min(cap, totals[0]) + totals[1]
        model = toxicity.fit(rows, totals)
        flat = toxicity.score(docs.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))), model)
        out[cap] = flat.agg(F.avg("score"), F.sum("predicted")).first()
    whole, capped = out[100_000], out[400]
    assert abs(whole[0] - capped[0]) < 0.01
    assert abs(whole[1] - capped[1]) <= 0.02 * whole[1] + 2
