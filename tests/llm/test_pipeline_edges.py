"""The pipeline on awkward and on empty tables: no crash, no lost document, ids as they came."""

import corpus_pipeline as c
from test_operators import brute_groups

from trustframe.llm import decontaminate, mixing, quality
from trustframe.llm.common import table

BIG = 2**60


def test_empty_tables(spark, edge):
    assert c.run(spark, edge + "-empty").count() == 0


def test_edge_tables(spark, edge):
    docs = table(spark, edge, "documents")
    for name, stage in c.STAGES:
        out = c.stored(stage(spark, docs, edge), "edge-stage")
        if name != "token output":
            assert out.columns == docs.columns, name
            assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in docs.collect()}, name
        else:
            assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in docs.collect())
        docs = out


def test_large_ids_and_nulls_pass_every_stage(spark, tmp_path):
    """Unrelated good documents all arrive, whatever their ids; of near copies the smallest id."""
    words = lambda k: " ".join(f"{w} the number{k}x{j}" for j, w in enumerate("and then it was of a kind that one would be with".split()))
    rows = [(BIG + 2 * k + 1, words(k), "en", "s", len(words(k))) for k in range(4)]
    rows += [(None, words(9), "en", None, len(words(9))), (BIG + 100, words(0) + " more", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "nothing of this stands in any of the documents at all here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = table(spark, str(tmp_path), "documents")
    assert quality.keep_good(docs).count() == 6
    groups = {head for _, _, head in brute_groups([(r[0], r[1]) for r in rows])}
    one = c.one_of_each(spark, docs, str(tmp_path))
    assert {r.doc_id for r in one.collect()} == groups == {None, *[BIG + 2 * k + 1 for k in range(4)]}
    assert decontaminate.remove_documents(one, table(spark, str(tmp_path), "benchmark")).count() == 5
    taken = {r.doc_id for r in mixing.mix_amounts(one).where("taken > 0").collect()}
    assert {r.doc_id for r in c.run(spark, str(tmp_path)).collect()} == taken <= groups
