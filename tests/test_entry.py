import __spark_entry__ as E


def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert df.columns == ["doc_id", "rank", "tag", "score"]
    assert df.count() > 0
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs) and len(qs) >= 40


def test_same_result_after_repartition(spark):
    from tagweave.operators.features import prepare_documents
    from tagweave.operators.keywords import keyword_tags
    from tagweave.sources.tables import read_table
    docs = prepare_documents(read_table(spark, E.SMOKE_DIR, "documents"))
    a = sorted(map(tuple, keyword_tags(docs.repartition(1)).collect()))
    b = sorted(map(tuple, keyword_tags(docs.repartition(7)).collect()))
    assert a == b
