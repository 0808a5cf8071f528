"""What the operators hold at once, and what they read."""

from pyspark.sql import functions as F

from weftline.llm import decontaminate, quality_rules
from weftline.llm.quality_rules import Rule


def _nodes(df, name):
    return df._jdf.queryExecution().executedPlan().toString().count(name)


def test_blocks_of_a_benchmark_are_not_nested(spark, monkeypatch):
    """However many blocks there are, a task of the result runs one Python stage, and one block's broadcast lives at a time."""
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 12)
    docs = spark.createDataFrame([(k, f"lead {k} a{k % 7} b{k % 7} c{k % 7} d tail a3 b3 c3 d", "own") for k in range(40)] + [(None, None, "own")], "doc_id long, text string, item_ids string")
    bench = spark.createDataFrame([(k, f"a{k} b{k} c{k} d and more of item {k}") for k in range(7)], "item_id long, text string")
    alive, most, real = [], [], spark.sparkContext.broadcast

    def counted(value):
        sent = real(value)
        alive.append(sent)
        most.append(len(alive))
        destroy = sent.destroy
        sent.destroy = lambda *a: (alive.remove(sent), destroy(*a))
        return sent

    monkeypatch.setattr(spark.sparkContext, "broadcast", counted)
    out = decontaminate.find_leaks(docs, bench, window=4)
    assert _nodes(out, "MapInArrow") == 1 and len(most) > 4 and max(most) == 1
    got = {r["doc_id"]: r for r in out.collect()}
    monkeypatch.undo()
    whole = {r["doc_id"]: r for r in decontaminate.find_leaks(docs, bench, window=4).collect()}
    assert got == whole and got[5]["item_ids"] == ["3", "5"] and got[None]["n_words"] == 0
    assert set(out.columns) == {"doc_id", "text", "n_words", "removal_spans", "item_ids"}


def test_the_sample_reads_some_files_only(spark, tmp_path):
    spark.range(4000).select("id", F.concat(F.lit("word "), "id").alias("text")).repartition(40).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d").select("text")
    some = quality_rules.some_files(docs, 4)
    assert some.count() == 400 and some.select(F.input_file_name()).distinct().count() == 4
    some.select(F.length("text")).collect()
    assert "file_path" in some._jdf.queryExecution().executedPlan().toString().split("DataFilters")[1].split("]")[0]
    assert quality_rules.some_files(docs, 40).count() == 4000 and quality_rules.some_files(docs.groupBy("text").count(), 4).count() == 4000
    made = spark.range(10).select(F.lit("a b").alias("text"))
    assert quality_rules.some_files(made).count() == 10


def test_rules_are_not_charged_for_measures_that_are_made_anyway(spark):
    """n_repeat_words is dear where it must be made, and costs nothing where it is ready."""
    docs = spark.range(300).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.concat(F.lit("w"), (i * 7 + F.col("id")) % 97)), " ").alias("text"))
    first = Rule("repeats", lambda m: m("n_repeat_words") > 0)  # rejects all
    second = Rule("pairs", lambda m: m("n_top_pair") > 0)  # rejects all too, and must be made
    third = Rule("words", lambda m: m("n_words") < 0)
    assert [r.name for r in quality_rules.rule_order(docs, (third, second, first), ready=tuple(quality_rules.MEASURES))][0] == "repeats"
    assert [r.name for r in quality_rules.rule_order(docs, (Rule("few", lambda m: m("n_words") > 0), first))][0] == "few"
