from weftline import queries


def test_search_ranked_reads_whole_texts(spark, tmp_path):
    texts = ["one. two. three. four. five. the cat. a bag of it", "the cat. a bag of it", "a of b. c. d. e. f. g. h. the end", "one. two. three. four. five. six"]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_items"], r["priority"]) for r in queries.search_ranked(spark, str(tmp_path)).collect()}
    assert got == {0: (2, 2), 1: (2, 2), 2: (2, 2)}
