import random

from weftline.llm import jaccard_join


def test_ids_that_repeat_or_are_null(spark):
    """Texts of six groups of near copies: ids name two different texts each, or are null."""
    rng = random.Random(7)
    rows = []
    for group in range(6):
        base = [f"g{group}w{k}" for k in range(140)]
        for copy in range(5):
            words = list(base)
            words[rng.randrange(140)] = f"new{copy}"
            rows.append((None if group % 2 else 10 * (group // 4) + copy, " ".join(words)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    links = [sum(i != j and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_links"]) for r in got) == sorted((i is None, i or 0, n) for (i, _), n in zip(rows, links, strict=True))
    assert min(links) > 0
    kept = jaccard_join.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == 6
