"""The pipeline on small tables: planted cases through run(), and odd rows through every stage."""

import hashlib
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import good, leaks, shingle_sets
from weftline.llm.queries import QUERIES, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    vocab = [f"{a}{b}{c}" for a in "ktpm" for b in "aeiou" for c in ("ra", "no", "sel", "vim")]
    return [rng.choice(vocab) + ("" if rng.random() < 0.9 else ".") for _ in range(n)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents with planted cases, labels and benchmark, as the pipeline reads them."""
    rng, rows, labels = random.Random(8), [], []
    item = " ".join(f"bench{k}" for k in range(30))
    for k in range(420):
        w = prose(rng, rng.randint(60, 200))
        kind = ("toxic" if k % 3 == 0 else "clean") if k < 360 else ("leak", "copy", "near", "short", "clean", "leak_all")[k % 6]
        if kind == "toxic":
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["grumbo", "grumbit", "snorf"]))
        text = " ".join(w)
        if kind == "leak":
            text = " ".join(w[:50]) + " " + item + " " + " ".join(w[50:])
        elif kind == "copy":
            text = rows[5][1]
        elif kind == "near":
            text = rows[7][1] + f" end{k}"
        elif kind == "short":
            text = "too short"
        elif kind == "leak_all":
            text = item + " " + item[: item.index(" bench20")] + " " + item
        rows.append((k, text, "en", kind, len(text)))
        if k < 360:
            labels.append((k, 1, int(kind == "toxic")))
    rows += [(900, None, None, "null", None), (901, "", "en", "empty", 0), (902, "... !", "en", "blank", 5)]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, item


def test_run(spark, tables):
    from tokenizers import Tokenizer

    folder, rows, item = tables
    shared = Path(spark.conf.get("spark.checkpoint.dir")) / "weftline"
    before = set(shared.glob("*")) if shared.exists() else set()
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    text, kind = {r[0]: r[1] for r in rows}, {r[0]: r[3] for r in rows}
    passed = [k for k in text if good(text[k])]
    assert {kind[k] for k in text if k not in passed} == {"short", "null", "empty", "blank", "leak_all"}
    clean = [k for k in passed if kind[k] != "toxic"]
    toxic_left = [k for k in got if kind[k] == "toxic"]
    assert len(toxic_left) <= 0.05 * sum(x == "toxic" for x in kind.values())
    # Of the documents that aren't toxic, one of each group of near copies stays.
    sets = shingle_sets([text[k] for k in clean])
    first = {k for j, k in enumerate(clean) if not any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i in range(j))}
    kept = set(got) - set(toxic_left)
    assert kept <= first and len(kept) >= 0.95 * len(first)
    lib = Tokenizer.from_file(tokenizer_path())
    for k in kept:
        t = text[k]
        if kind[k] == "leak":
            t = t.replace(item, "")
        ids = lib.encode(t, add_special_tokens=False).ids
        assert got[k]["n_tokens"] == len(ids) and got[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert len(set(shared.glob("*")) - before) <= 1  # the last stage's input


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    text = " ".join(prose(rng, 80))
    rows = [(None, text, None, None, None), (1, text, "en", "s", 9), (1, text, "en", "s", 9), (2, None, None, None, None), (3, "", "en", "s", 0), (None, None, None, None, None), (4, "...", "en", "s", 3), (5, " ".join(prose(rng, 30_000)), "en", "s", 1)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("_row", F.lit("x")).withColumn("KEY", F.lit(1)).withColumn("n_words", F.lit("y")).withColumn("score", F.lit("z")).withColumn("removal_spans", F.lit(0)), text


#: Ids of the odd rows that each stage leaves, None for a null id.
LEFT = [[1, 1, 5, None], [1, 1, 2, 3, 4, 5, None, None], [1, 2, 3, 4, 5, None], [1, 1, 2, 3, 4, 5, None, None], [1, 1, 2, 3, 4, 5, None, None]]


@pytest.mark.parametrize("k", range(5))
def test_odd_rows(spark, tables, odd, k):
    folder = tables[0]
    docs, text = odd
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, folder)
    rows = out.collect()
    assert sorted((r["doc_id"] for r in rows), key=lambda x: (x is None, x or 0)) == LEFT[k]
    empty = stage(spark, docs.where("false"), folder)
    assert empty.count() == 0 and empty.columns == out.columns
    if k < 4:
        assert out.columns == corpus_pipeline.COLUMNS
        same = {(r["doc_id"], r["text"], r["n_chars"]) for r in docs.collect()}
        assert {(r["doc_id"], r["text"], r["n_chars"]) for r in rows} <= same
    else:
        assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3)} == {0}


def test_leaks_are_cut(spark, tables):
    folder, rows, item = tables
    docs = spark.createDataFrame([r for r in rows if r[3].startswith("leak")], SCHEMA)
    out = {r["doc_id"]: r for r in corpus_pipeline.decontaminated(spark, docs, folder).collect()}
    for k, text, _, kind, _ in rows:
        if kind == "leak":
            assert out[k]["text"] == text.replace(item, "") and out[k]["n_chars"] == len(out[k]["text"])
            assert next(leaks([out[k]["text"]], [(1, item)], 10))[2] == []
        elif kind == "leak_all":
            assert k not in out


def test_every_query_of_the_package_runs(spark, tables):
    """All opN_ queries on the planted tables: a row for each document, held_out and digests as their contracts say."""
    import zlib

    from tokenizers import Tokenizer

    folder, rows, _ = tables
    text = {r[0]: r[1] or "" for r in rows}
    got = {n: {r["doc_id"]: r for r in QUERIES[n](spark, folder).collect()} for n in QUERIES if n.startswith("op") and n not in ("op2_url_filters", "op4_chat_format", "op13_vector_codes")}
    assert len(got) == 10 and all(set(x) == set(text) for x in got.values())
    lib = Tokenizer.from_file(tokenizer_path())
    for k, t in text.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        one, five, six, eight, eleven, twelve = (got[n][k] for n in ("op1_toxicity", "op5_bpe", "op6_token_counts", "op8_lm_scoring", "op11_fill_in_middle", "op12_language_id"))
        crc = zlib.crc32(str(k).encode())
        assert one["held_out"] == (crc % 5 == 0) and eight["held_out"] == (crc % 10 == 0)
        assert 0 <= one["score"] <= 1 and one["predicted"] == int(one["score"] >= 0.5)
        assert five["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and five["n_tokens"] == six["n_tokens"] == len(ids)
        assert five["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        assert six["n_bytes"] == len(t.encode()) and six["over_limit"] == (len(ids) > 1024)
        assert eight["n_known"] <= eight["n_tokens"] and eight["score"] < 0
        assert eleven["restored_sha256"] == five["decoded_sha256"] and eleven["n"] == len(re.findall("[A-Za-z]+|[^A-Za-z]", t))
        assert twelve["held_out"] == (crc % 4 == 2) and twelve["lang_pred"] == ("en" if re.search("[a-z]", t) else "und") and 0 <= twelve["score"] <= 1
    held = [k for k, r in got["op1_toxicity"].items() if r["held_out"] and k < 360]
    assert sum(got["op1_toxicity"][k]["predicted"] == int(k % 3 == 0) for k in held) >= 0.95 * len(held)
