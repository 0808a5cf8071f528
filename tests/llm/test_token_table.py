import re
from collections import Counter

from pyspark.sql import functions as F

from weftline.llm import bpe, queries, token_counts


def test_table_from_a_bounded_set_of_tasks(spark, monkeypatch):
    """At most TASKS partitions are read for the table, nothing is shuffled, and counts don't depend on the table."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    texts = [f"the cat {'x' * (k % 90)} number{k} sat" for k in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(40)
    lib = Tokenizer.from_file(path)
    want = {k: len(lib.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}
    for tasks, table in ((3, 1 << 16), (64, 5), (1, 0)):
        monkeypatch.setattr(token_counts, "TASKS", tasks)
        monkeypatch.setattr(token_counts, "TABLE", table)
        top = token_counts.frequent_pre_tokens(docs, bpe.load_spec(path))
        assert len(top) <= table and max(map(len, top), default=0) <= token_counts.PIECE_BYTES
        assert not table or set(top[:3]) <= {b" sat", b" cat", b"the", b" number"}
        out = token_counts.count_tokens(docs, path)
        assert {r["doc_id"]: r["n_tokens"] for r in out.collect()} == want
    local = token_counts.count_tokens(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), path)
    assert "Exchange" not in local._jdf.queryExecution().executedPlan().toString()
    assert token_counts.frequent_pre_tokens(docs.where(F.lit(False)), bpe.load_spec(path)) == []


def test_the_table_counts_all_texts(spark, monkeypatch):
    """Every partition's pre-tokens count in full, also those of a task that holds few at a time; whole levels fit a small table."""
    path = queries.tokenizer_path()
    texts = [f"the of{'abcdefghij'[k % 10] * (k // 10 + 1)} only in part {k} {'xyz' * (k % 7)} the" for k in range(40)] + ["", None]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), 42), "doc_id long, text string")
    count = Counter(p.encode() for t in texts for p in re.findall(r" ?[a-z]+| ?[0-9]+|\s+(?!\S)|\s+", t or ""))
    want = sorted(count, key=lambda p: (-count[p], p))
    for held in (1 << 17, 3):
        monkeypatch.setattr(token_counts, "HELD", held)
        assert token_counts.frequent_pre_tokens(docs.coalesce(3), bpe.load_spec(path)) == want
    assert token_counts.frequent_pre_tokens(docs, bpe.load_spec(path)) == want
    for size in (0, 5, 12, 60):
        monkeypatch.setattr(token_counts, "TABLE", size)
        some = token_counts.frequent_pre_tokens(docs, bpe.load_spec(path))
        assert some == want[: len(some)] and len(some) <= size
        assert not some or size < 5 or count[want[len(some) - 1]] > count[want[len(some)]]
