"""Keyed retry state against a plain loop over attempts."""

import random

from weftline.streaming import attempts


def by_hand(rows):
    items, members, history = {}, {}, []
    for key, attempt in sorted({(r[0], r[1]) for r in rows if r[0] is not None}):
        mine = {r[2]: (r[3], r[4]) for r in rows if r[:2] == (key, attempt)}
        status, count, last = items.get(key, (None, None, None))
        if None not in mine or status == "done" or (status == "failed" and not mine[None][1]):
            continue
        old = members.get(key, {})
        members[key] = {m: (o, None if o == "done" else (-1 if old.get(m, (0, None))[1] is None else old[m][1]) + 1) for m, (o, _) in mine.items() if m is not None}
        if mine[None][0] == "done":
            if status == "failed":
                history.append((key, attempt, "resolved", None))
            items[key] = ("done", None, attempt)
        else:
            items[key] = ("failed", (-1 if count is None else count) + 1, attempt)
            history.append((key, attempt, "failure", mine[None][0]))
    return {k: v for k, v in items.items()}, {(k, m): v for k, some in members.items() for m, v in some.items()}, sorted(history)


def told(spark, checkpoint):
    items, members, history = attempts.state(spark, checkpoint)
    return (
        {r["key"]: (r["status"], r["retry_count"], r["attempt"]) for r in items.collect()},
        {(r["key"], r["member"]): (r["outcome"], r["retry_count"]) for r in members.collect()},
        sorted((r["key"], r["attempt"], r["event"], r["error"]) for r in history.collect()),
    )


def test_counts_over_runs_and_replays(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for attempt in range(1, 25):
        for key in rng.sample("abcdef", 4):
            rows.append((key, attempt, None, rng.choice(["bad layout", "timeout", "done", "timeout"]), rng.random() < 0.7))
            rows += [(key, attempt, m, rng.choice(["done", "unsupported"]), True) for m in rng.sample(["x.md", "y.md", "z.md"], 2)]
    rows.append((None, 3, None, "done", True))
    source, checkpoint, changes = (f"{tmp_path}/{n}" for n in ("in", "mark", "changes"))

    def deliver(some):
        spark.createDataFrame(some, attempts.ATTEMPT).coalesce(1).write.mode("append").parquet(source)
        attempts.follow(spark, source, checkpoint, changes)

    early, late = [r for r in rows if r[1] <= 12], [r for r in rows if r[1] > 12]
    deliver(early)
    assert told(spark, checkpoint) == by_hand(early)
    deliver(late + [r for r in early if r[0] == "a"])  # and one item's attempts once more
    assert told(spark, checkpoint) == by_hand(rows)
    attempts.follow(spark, source, checkpoint, changes)  # nothing new
    assert told(spark, checkpoint) == by_hand(rows)
    deliver([("g", 1, None, "timeout", False)])
    assert {r["key"] for r in spark.read.parquet(changes).where("epoch = 2").collect()} == {"g"}
