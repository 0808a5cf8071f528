import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import bpe, chat_format, decontaminate, fm_index, jaccard_join, license_scan, maxent_lm, quality_rules, queries, token_counts, toxicity, url_filters
from weftline.llm.graph import connected_components
from weftline.llm.textkit import HashTable, slices, words

WORD, INK = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum " * 20_000
TEXTS = [None, "", " \n\t ", "...", "one", "The cat sat on the mat. " * 20, "The cat sat on the mat. " * 20, "naïve Ünï 漢字 🙂 <|endoftext|> it's we'll", "a b c d e f g h i j k l m n o", LONG]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with the names of outputs."""
    rows = [(i, t, "x", 1.5) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "x", 1.5), (None, "one", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, score double")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def test_hash_table():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(1, 1 << 63, 5000).astype(np.uint64))
    t = HashTable(16)
    for part in np.array_split(keys, 7):
        t.put(part, np.searchsorted(keys, part).astype(np.int32))
    assert (t.get(keys) == np.arange(len(keys))).all()
    assert (t.get(rng.integers(1 << 63, (1 << 64) - 1, 1000, dtype=np.uint64)) == -1).all()


def test_bpe_like_library(spark, odd, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    lib = Tokenizer.from_file(path)
    rng = random.Random(5)
    parts = [*"ab'stmdre  \t\n\r.,!12½Ⅷéß 　\x1c\x85漢ñ🙂́", "<|endoftext|>", "'re", " the", "ing", "aaaa"]
    enc = bpe.encoder(bpe.load_spec(path))
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    got = []
    for _, _, data, offsets in slices(pa.array(texts)):
        ids, at = enc.slice_ids(data, offsets)
        got += [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]
    assert got == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    rows = bpe.decode(bpe.encode(odd, path), path, text_col="back").collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert r["back"] == (r["text"] or "") and r["ids"] == lib.encode(r["text"] or "", add_special_tokens=False).ids and r["score"] in (1.5, None)
    for r in bpe.round_trip(odd, path).collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    for r in token_counts.count_tokens(odd, path, limit=5).collect():
        n = len(lib.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((r["text"] or "").encode()), n, n > 5)
    assert bpe.round_trip(none, path).count() == token_counts.count_tokens(none, path).count() == 0


def test_fm_index():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        for sigma in (2, 3, 9):
            text = rng.integers(0, sigma, n)
            text[-1] = 0
            index = fm_index.FmIndex(text, sigma)
            phrases = rng.integers(1, sigma, (20, 3))
            which, low, high = index.search(phrases)
            found = {k: sorted(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(which, low, high, strict=True)}
            for k, p in enumerate(phrases):
                assert found.get(k, []) == [i for i in range(n - 2) if (text[i : i + 3] == p).all()]


def leaks(docs, items, window):
    parsed = [(i, WORD.findall(lower(t))) for i, t in items]
    for t in docs:
        w, hit, found = WORD.findall(lower(t)), set(), set()
        for i, q in parsed:
            n = min(window, len(q))
            phrases = {tuple(q[p : p + n]) for p in range(len(q) - n + 1)} if n else set()
            for p in range(len(w) - n + 1):
                if n and tuple(w[p : p + n]) in phrases:
                    hit |= set(range(p, p + n))
                    found.add(str(i))
        yield len(w), hit, sorted(found)


@pytest.mark.parametrize("block", [1 << 20, 5])
def test_decontamination(spark, odd, none, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    items = [(1, "sat on the MAT the cat"), (22, "d e f g h i j k l m n"), (3, None), (4, "..."), (5, "one"), (5, "one"), (7, "cat sat")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.find_leaks(odd, bench, window=4).collect()
    assert len(rows) == len(TEXTS) + 2
    for r, (n, hit, found) in zip(rows, leaks([r["text"] for r in rows], items, 4), strict=True):
        assert r["n_words"] == n and r["item_ids"] == found
        assert {w for s in r["removal_spans"] for w in range(s["first_word"], s["end_word"])} == hit
    cut = {r["doc_id"]: r["text"] for r in decontaminate.find_leaks(odd, bench, window=4, cut=True).collect()}
    assert cut[8] == "a b c  o" and cut[4] == ""
    assert decontaminate.find_leaks(odd, bench.where("false")).where(F.size("removal_spans") > 0).count() == 0
    assert decontaminate.find_leaks(none, bench).count() == 0


def shingle_sets(texts):
    out = []
    for t in texts:
        w = WORD.findall(lower(t))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def test_jaccard_join(spark, odd, none, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "TILE", 3)
    rng = random.Random(3)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 120))] for _ in range(12)]
    texts = list(TEXTS)
    for b in base:
        for _ in range(rng.randint(1, 12)):
            c = list(b)
            for _ in range(rng.randint(0, 4)):
                c[rng.randrange(len(c))] = "zz"
            texts.append(" ".join(c))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = shingle_sets(texts)
    links = {i: {j for j in range(len(sets)) if i != j and a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9} for i, a in enumerate(sets)}
    least = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least[i] = min(seen)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_join(docs).collect()}
    assert got == {i: (least[i], len(links[i])) for i in links}
    kept = sorted(r["doc_id"] for r in jaccard_join.keep_one_of_each(docs).collect())
    assert kept == sorted(set(least.values()))
    again = jaccard_join.jaccard_join(odd).collect()
    assert len(again) == len(TEXTS) + 2 and {r["class_id"] for r in again if r["doc_id"] is None} == {4}
    assert jaccard_join.jaccard_join(none).count() == 0
    one = jaccard_join.keep_one_of_each(odd.withColumn("_row", F.lit(7)).withColumn("key", F.lit("mine")))
    assert sorted(r["doc_id"] for r in one.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9] and one.columns[-2:] == ["_row", "key"]
    assert jaccard_join.keep_one_of_each(none).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (102, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def measures(t):
    w = INK.findall(t or "")
    seen, cover = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            cover |= {p + k for p in at for k in range(3)}
    lines = [x for x in (t or "").split("\n") if INK.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)


def good(t):
    """Whether no quality rule rejects a text."""
    n, chars, symbols, dup, rep = measures(t)
    w = INK.findall(t or "")
    top, pair = (max(Counter(x).values(), default=0) for x in (w, zip(w, w[1:], strict=False)))
    return not (n < 50 or 100 * rep > 50 * n or 5 * symbols > n or chars < 2 * n or chars > 40 * n or 2 * dup > n or 100 * top > 30 * n or 200 * pair > 20 * n)


def test_quality_rules(spark, odd, none, monkeypatch):
    more = ["a b c a b c x", "# *\n# *\n\n# *", "x " * 60, "good " * 3 + " ".join(f"w{i}" for i in range(80)), " | ".join(f"cell{i}" for i in range(70)), " ".join(f"so do{i % 9} w{i} on" for i in range(90)), " ".join(f"w{i}" for i in range(40_000)) + " w1 w2 w3 w4"]
    docs = odd.unionByName(spark.createDataFrame([(90 + i, t, None, None) for i, t in enumerate(more)], odd.schema))
    rows = quality_rules.apply_rules(docs).collect()
    assert len(rows) == len(TEXTS) + 2 + len(more)
    for r in rows:
        n, chars, symbols, dup, rep = measures(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep)
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n)
        assert r["kept"] == good(r["text"])
    assert {r["doc_id"] for r in rows if r["kept"]} == {93, 96}
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in rows if r["kept"])
    for order in (quality_rules.RULES, quality_rules.RULES[::-1]):
        assert [r["kept"] for r in quality_rules.apply_rules(docs, order=list(order)).collect()] == [r["kept"] for r in rows]
    monkeypatch.setattr(quality_rules, "PACKED", 3)
    assert [r["n_repeat_words"] for r in quality_rules.apply_rules(docs).collect()] == [r["n_repeat_words"] for r in rows]
    assert quality_rules.apply_rules(none).count() == quality_rules.keep_good(none).count() == 0
    clash = quality_rules.apply_rules(docs.withColumn("N_WORDS", F.lit("mine")).withColumn("kept", F.lit(1)).withColumn("_words", F.lit("w")))
    assert [(r["kept"], r["_words"]) for r in clash.collect()] == [(r["kept"], "w") for r in rows]


def test_later_rules_do_not_run(spark, odd):
    """A rule that would raise stands behind rules that reject every row."""
    few = quality_rules.Rule("few", lambda m: m("n_words") < 10**9)
    fatal = quality_rules.Rule("fatal", lambda m: F.raise_error(F.concat(F.lit("ran: "), m("n_top_word").cast("string"))).cast("boolean"))
    rows = quality_rules.apply_rules(odd, rules=(few, fatal), order=[few, fatal]).collect()
    assert len(rows) == len(TEXTS) + 2 and not any(r["kept"] for r in rows)
    with pytest.raises(Exception, match="ran: "):
        quality_rules.apply_rules(odd, rules=(few, fatal), order=[fatal, few]).collect()


def test_order_by_rejections_and_cost(spark):
    docs = spark.createDataFrame([(i, "a b " * 400 if i % 2 else "c " * 30) for i in range(200)], "doc_id long, text string")
    dear = quality_rules.Rule("dear", lambda m: m("n_top_pair") + m("n_repeat_words") + m("n_top_word") < 0)
    cheap = quality_rules.Rule("cheap", lambda m: m("n_words") < 50)
    never = quality_rules.Rule("never", lambda m: m("n_words") < 0)
    assert [r.name for r in quality_rules.rule_order(docs, (dear, never, cheap))] == ["cheap", "never", "dear"]


def test_chat_format(spark):
    nasty = ["", None, "\\", "\\b\\h", "### x </turn>\n</turn>", "#### :", "</tu</turn>rn>", "\\### Assistant: </turn> ok", "a\nb"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(nasty)] + [(2, 0, "a:b\\c", "x"), (2, 0, None, "y"), (None, 1, "user", "z"), (3, 5, "user", "q"), (3, 6, "assistant", "r"), (4, None, "system", "s")]
    out = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [(r, t or "") for _, _, r, t in rows[:9]]
    assert out[1]["loss_text"] == "".join(t or "" for t in nasty[1::2])
    assert "".join(s["text"] for s in out[1]["segments"]) == out[1]["formatted"] and not out[1]["valid"]
    assert [(t["role"], t["text"]) for t in out[2]["turns"]] == [("", "y"), ("a:b\\c", "x")] and out[2]["first_error"] == 0
    assert out[3]["valid"] and out[3]["first_error"] is None and not out[4]["valid"] and None in out
    assert chat_format.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_license_scan(spark, odd, none):
    texts = ["Released under the MIT License.", "under the\nMIT license; Apache License, Version 2", "under the mit", "CC-BY-NC cc by nc", "Licensed under CC BY-SA 4.0", "work is licensed under the GNU general public license version 3 by us"]
    rows = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [sorted((p["label"], p["word"]) for p in r["phrases"]) for r in rows] == [[("mit", 1)], [("apache-2", 4), ("mit", 0)], [], [("cc-by-nc", 0), ("cc-by-nc", 3)], [], []]
    found = []
    for t in texts:
        own = set()
        for line in t.split("\n"):
            for text, label in license_scan.TEMPLATES:
                s = set(text.split())
                if len(s & set(WORD.findall(lower(line)))) >= 0.9 * len(s) - 1e-9:
                    own.add(label)
        found.append(sorted(own))
    assert [sorted({m["label"] for m in r["matches"]}) for r in rows] == found
    assert found[4] == ["cc-by-sa"] and found[5] == ["gpl-3"]
    assert license_scan.scan_licenses(odd).count() == len(TEXTS) + 2 and license_scan.scan_licenses(none).count() == 0


def test_url_filters(spark, monkeypatch):
    changes = [("bad.example", "spam", "2024-01-10", "add"), ("bad.example", "spam", "2024-01-10", "add"), ("bad.example", "spam", "2024-01-20", "remove"), ("a.bad.example/x", "path", "2024-01-01", "add"), ("one", None, "2024-01-01", "add")]
    listed = spark.createDataFrame(changes, "key string, category string, day string, action string").withColumn("day", F.col("day").cast("date"))
    urls = [("https://a.bad.example/x/y?q", "2024-01-10"), ("http://bad.example:80/", "2024-01-19"), ("http://bad.example/", "2024-01-20"), ("http://notbad.example/", "2024-01-15"), ("http://a.bad.example/xy", "2024-01-05"), (None, "2024-01-15"), ("nonsense", "2024-01-15"), ("http://bad.example/", None), ("http://bad.example:80/", "2024-01-19")]
    caps = spark.createDataFrame([(i, u, d, "mine") for i, (u, d) in enumerate(urls)], "page_id long, url string, fetched string, blocked string").withColumn("fetched", F.col("fetched").cast("date"))
    want = [["path", "spam"], ["spam"], [], [], [], [], [], [], ["spam"]]
    for bound in (100, 0):
        monkeypatch.setattr(url_filters, "BROADCAST_ROWS", bound)
        assert [r["categories"] for r in url_filters.filter_urls(caps, listed).orderBy("page_id").collect()] == want
    deep = "z.y.x.w.v.u.t.s.r.bad.example/1/2/3/4/5/6"
    below = spark.createDataFrame([(1, f"http://q.{deep}", "2024-01-02"), (2, f"http://{deep}/7", "2024-01-02")], "u long, url string, d string").withColumn("fetched", F.col("d").cast("date"))
    more = listed.unionByName(spark.createDataFrame([(deep, "path", "add"), ("z." + deep.split(".", 1)[1].split("/")[0], "host", "add")], "key string, category string, action string").withColumn("day", F.lit("2024-01-01").cast("date")))
    assert [(r["u"], r["d"], r["categories"]) for r in url_filters.filter_urls(below, more).orderBy("u").collect()] == [(1, "2024-01-02", ["host"]), (2, "2024-01-02", ["host", "path"])]
    assert url_filters.filter_urls(caps, listed.where("false")).where("blocked").count() == 0
    assert url_filters.filter_urls(caps.where("false"), listed).count() == 0


def test_toxicity_learns(spark, odd, none):
    rng = random.Random(2)
    vocab = [f"{a}{b}{c}" for a in "ktpm" for b in "aeiou" for c in ("ra", "no", "sel", "vim")]
    texts, labels = [], []
    for k in range(700):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 150))]
        label = int(k % 3 == 0)
        if label:
            w[rng.randrange(len(w))] = rng.choice(["grumbo", "grumbit", "grumby", "snorf"])
        texts.append(" ".join(w))
        labels.append(label)
    m = toxicity.fit(texts[:500], labels[:500], 1 / 3)
    s = np.concatenate([toxicity.score_slice(m, d, o) for _, _, d, o in slices(pa.array(texts[500:]))])
    assert ((s >= 0.5) == (np.array(labels[500:]) == 1)).mean() > 0.95
    rows = toxicity.score(odd, m).collect()
    assert len(rows) == len(TEXTS) + 2 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(none, m).count() == 0
    assert toxicity.score(odd, toxicity.fit([], [], 0.0)).where("score <> 0").count() == 0


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    m = toxicity._new_model(rng)
    x = rng.normal(size=(6, 3, toxicity.INPUTS)).astype(np.float32)
    size, label = np.array([6, 4, 1]), np.array([1, 0, 1], np.float32)

    def loss():
        logit = toxicity._gradients(m, x, size, label)[2]
        return float(np.mean(np.log1p(np.exp(-logit)) * label + np.log1p(np.exp(logit)) * (1 - label)))

    grad, dx, _ = toxicity._gradients(m, x, size, label)
    for name in ("wx", "wh", "bias", "attend", "query", "out"):
        w = getattr(m, name)
        for at in [tuple(rng.integers(0, s) for s in w.shape) for _ in range(4)]:
            old = w[at]
            w[at] = old + 1e-2
            up = loss()
            w[at] = old - 1e-2
            down = loss()
            w[at] = old
            assert abs((up - down) / 2e-2 - grad[name][at]) < 2e-3
    assert (dx[4:, 1] == 0).all() and (dx[1:, 2] == 0).all()


def test_lm_scoring(spark, odd, none):
    rng = random.Random(4)
    texts = [" ".join(rng.choice((["der", "die", "das", "ung"], ["the", "of", "and", "ing"])[i % 2]) for _ in range(40)) for i in range(200)] + TEXTS
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = maxent_lm.score_lm(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0).collect()
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))}
    counts = {}
    for i, t in enumerate(texts):
        if not held[i]:
            for w in [*INK.findall(lower(t)), None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        own = [*INK.findall(lower(texts[r["doc_id"]])), None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(own), sum(w in counts for w in own), n)
        assert abs(r["base_score"] - sum(np.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in own)) < 1e-6 * len(own)
    test = [r for r in rows if r["held_out"] and r["doc_id"] < 200]
    assert sum(r["score"] for r in test) > sum(r["base_score"] for r in test)
    assert maxent_lm.score_lm(odd.select("doc_id", "text"), F.lit(True)).count() == len(TEXTS) + 2
    assert maxent_lm.score_lm(none, F.lit(True)).count() == 0


def test_words_by_bytes():
    texts = ["A-b Cé 1_2", "", "éè", "x"]
    (_, _, data, offsets), *_ = slices(pa.array(texts))
    _, start, end, first = words(data, offsets)
    low = bytes(data).lower()
    assert [low[a:b].decode() for a, b in zip(start, end, strict=True)] == [w for t in texts for w in WORD.findall(lower(t))] and first.tolist() == [0, 5, 5, 6, 7]
