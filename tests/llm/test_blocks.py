"""Benchmark blocks of decontamination pass through the driver one at a time."""

from pyspark.sql import functions as F

from trustframe.llm import decontaminate
from trustframe.llm.common import table


def test_one_block_is_alive(spark, edge, monkeypatch):
    docs, items = table(spark, edge, "documents"), table(spark, edge, "benchmark")
    facts = lambda df: sorted(map(str, df.select("key", "n_words", decontaminate.covered(F.col("hits")), "items").collect()))
    whole = facts(decontaminate.find(docs, items))
    alive, most = [0], [0]
    send = spark.sparkContext.broadcast

    def broadcast(value):
        sent = send(value)
        alive[0] += 1
        most[0] = max(most[0], alive[0])
        give_back = sent.destroy

        def destroy(blocking=False):
            alive[0] -= 1
            give_back(blocking)

        sent.destroy = destroy
        return sent

    monkeypatch.setattr(spark.sparkContext, "broadcast", broadcast)
    got = decontaminate.find(docs, items, block_windows=1)
    assert most[0] == 1
    assert facts(got) == whole
