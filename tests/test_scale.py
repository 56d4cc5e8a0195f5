"""Steps whose time, rows moved or task size must not outgrow the input."""

from pyspark.sql import functions as F

from tagweave.functions.text import ENGLISH_STOP_WORDS, clean_tokens, normalize_text, remove_stop_words
from tagweave.session import spread


def test_spread_splits_one_row_group(spark, tmp_path):
    """A large row group under many splits is read by one of them; the rows must still be dealt out."""
    path = str(tmp_path / "one")
    spark.range(40000).select("id", F.repeat(F.lit("word "), 3).alias("text")).coalesce(1).write.parquet(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() > 4
        sizes = [r["count"] for r in spread(df, 4, 1000).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sum(sizes) == 40000 and max(sizes) <= 2000


def test_stop_words_are_looked_up_not_scanned(spark):
    df = spark.createDataFrame([(1, "The cat AND don't menu login house\n12it's a-b_c don t http://x y\rz{html}<b\n>café")], "i int, t string")
    tokens, removed, plain = df.select(clean_tokens(F.col("t")), remove_stop_words(F.col("t")), normalize_text(F.col("t"))).first()
    assert tokens == ["cat", "dont", "house", "abc", "dont"[:0] or "café"] or tokens == ["cat", "dont", "house", "abc", "café"]
    assert not {w.lower() for w in removed.split(" ")} & set(ENGLISH_STOP_WORDS)
    assert "\n" not in plain and "\r" not in plain and "_" not in plain and "1" not in plain
    plan = df.select(clean_tokens(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in plan and "array_contains" not in plan


def test_documents_with_one_rare_term_in_common_are_not_sent(spark):
    """Neighbours on a ring share a term of their prefixes, but cannot reach the bound: no vector may move for them."""
    from tagweave.operators import neighbours as NB
    rows = []
    for i in range(64):
        rows += [(i, f"r{i:02d}", 0.15 ** 0.5), (i, f"r{(i + 1) % 64:02d}", 0.15 ** 0.5), (i, f"common{i % 8}", 0.7 ** 0.5)]
    w = spark.createDataFrame(rows, "doc_id long, term string, weight double")
    _, sent, _ = NB._meeting(w, 0.875, 8)
    assert sent.isEmpty()
    # copies in direction are sent and found across groups
    both = w.unionByName(w.where("doc_id < 8").withColumn("doc_id", F.col("doc_id") + 100))
    got = sorted(map(tuple, NB.neighbour_pairs(both, 0.875, 8).select("doc_a", "doc_b").collect()))
    assert got == [(i, i + 100) for i in range(8)]


def test_topic_rounds_move_one_row_per_term_of_a_block(spark, monkeypatch):
    """300 documents of the same 12 terms: a round moves 12 rows of weights for each block, not 3,600."""
    from tagweave.operators import topics as TP
    seen, meet = [], TP._meet

    def counted(bags, terms, beta, run, schema):
        seen.append((terms.count(), bags.count()))
        return meet(bags, terms, beta, run, schema)

    monkeypatch.setattr(TP, "_meet", counted)
    w = spark.range(300).select(F.col("id").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("t")).select(
        "doc_id", F.concat(F.lit("t"), F.col("t").cast("string")).alias("term"), (1.0 + F.col("doc_id") % (F.col("t") + 2)).alias("weight"))
    docs = spark.range(301).select(F.col("id").alias("doc_id"))
    one, many = (TP.fit_topics(w, docs, k=2, max_iter=2, block=b) for b in (1000, 100))
    assert seen[0] == (12, 300) and seen[3] == (36, 300)
    for a, b in zip(one, many):
        a, b = (sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in t.collect()) for t in (a, b))
        assert a == b and len(a) in (20, 602)


def test_given_topics_rank_terms_once(spark):
    """The ten terms of each document are read for the topics and again for the mean cosine: they are kept, tokens are not."""
    from conftest import SF001
    from tagweave.plans import registry
    _, _, top10 = registry._given_topics(spark, SF001)
    assert top10.storageLevel.useMemory and top10.storageLevel.useDisk
    top10.unpersist()


def test_kmeans_rounds_move_one_row_per_term_of_a_block(spark, monkeypatch):
    """300 documents of the same 12 terms: a round gives each block 12 rows of centres, and no row of a document and term moves."""
    from tagweave.operators import clustering as CL
    from tagweave.operators import vectors as V
    seen, meet = [], V.TermBlocks.meet

    def counted(self, terms, docs, run, schema):
        seen.append((self.blocks, 0 if terms is None else terms.count()))
        return meet(self, terms, docs, run, schema)

    monkeypatch.setattr(V.TermBlocks, "meet", counted)
    w = spark.range(300).select(F.col("id").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("t")).select(
        "doc_id", F.concat(F.lit("t"), F.col("t").cast("string")).alias("term"), (1.0 + F.col("doc_id") % (F.col("t") + 2)).alias("weight"))
    docs = spark.range(301).select(F.col("id").alias("doc_id"))
    one, many = (sorted(map(tuple, CL.kmeans(V.blocks_of(w, docs, size), docs, 2, max_iter=2).collect())) for size in (1000, 20))
    assert one == many and len(one) == 301
    assert {b for b, _ in seen} == {5, 16} and max(n for b, n in seen if b == 5) == 60 and max(n for b, n in seen if b == 16) <= 192


def test_tfidf_blocks_have_the_weights_of_tfidf(spark):
    from tagweave.operators import features as FE
    rows = [(1, ["aa", "bb", "aa", "c"]), (2, ["bb", "cc"]), (3, []), (4, ["c"])]
    tokens = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    labels = tokens.select("doc_id", F.col("doc_id").alias("cluster"))
    blocks = FE.tfidf_blocks(tokens)
    got = {(r.cluster, r.term): round(r.score, 12) for r in blocks.sums(labels).collect()}
    assert got == {(r.doc_id, r.term): round(r.weight, 12) for r in FE.tfidf(tokens).collect()}
    assert {r.doc_id: r.n2 for r in blocks.points.collect()} == {1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0}
    blocks.release()
