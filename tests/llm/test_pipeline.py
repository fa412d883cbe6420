import corpus_pipeline
from tidemill.llm import queries
from tidemill.llm.common import stored


def test_stages(spark, data, odd, none):
    """Each stage on all its predecessor kept; all but the last keep the columns; clean documents stay."""
    docs, names = odd, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, data), name)
        kept[name] = sorted((r["doc_id"] or 0) for r in docs.select("doc_id").distinct().collect())
        if name != "packing":
            assert docs.columns == odd.columns
    assert kept["language_id"] == [0, 1, 2, 3, 7, 8, 9, 10, 11, 13, 14, 15]
    assert kept["exact_dedup"] == [1, 7, 8, 9, 10, 11, 13, 14, 15]
    assert kept["near_dedup"] == kept["mixing"] == kept["packing"] == [1, 7, 9, 11, 13, 14]


def test_empty_corpus(spark, data, none):
    docs = none
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, data), name)
        assert docs.count() == 0


def test_queries_are_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.oracle_sql()) <= set(names)
