import hashlib

import pyarrow.parquet as pq

import corpus_pipeline
from weftline.llm import jaccard_join, quality_rules
from weftline.llm.queries import tokenizer_path

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    from tests.llm.test_operators import good as passes, leaks, shingle_sets
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    stages = [f for _, f in corpus_pipeline.STAGES]
    assert len(stages) == 5
    good = stages[0](spark, docs, DATA).cache()
    want = {k for k, r in before.items() if passes(r["text"])}
    assert {r["doc_id"] for r in good.collect()} == want and good.columns == docs.columns
    clean = stages[1](spark, good, DATA).cache()
    assert {r["doc_id"] for r in clean.collect()} <= want and clean.columns == docs.columns
    one = stages[2](spark, good, DATA).cache()
    rows = sorted(good.collect(), key=lambda r: r["doc_id"])
    sets, gone = shingle_sets([r["text"] for r in rows]), set()
    for i, a in enumerate(sets):
        gone |= {rows[j]["doc_id"] for j in range(i + 1, len(sets)) if a and len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9}
    assert {r["doc_id"] for r in one.collect()} == want - gone
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{DATA}/benchmark.parquet").to_pylist()]
    cut = {r["doc_id"]: r for r in stages[3](spark, docs, DATA).collect()}
    for (k, r), (n, hit, _) in zip(before.items(), leaks([r["text"] for r in before.values()], items, 10), strict=True):
        if not hit:
            assert cut[k]["text"] == r["text"] and cut[k]["n_chars"] == r["n_chars"]
        elif len(hit) < n:
            assert next(leaks([cut[k]["text"]], [("x", " ".join([]))], 10))[0] == n - len(hit)
        else:
            assert k not in cut
    lib = Tokenizer.from_file(tokenizer_path())
    for r in stages[4](spark, docs, DATA).collect():
        ids = lib.encode(before[r["doc_id"]]["text"], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert jaccard_join.SHINGLE == 5 and quality_rules.RULES[0].base
