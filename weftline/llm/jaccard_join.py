"""N-gram Jaccard self-join with Bayesian candidate pruning.

Every document is the set of its five-word shingles (a document of fewer words, but not none, is one
shingle). The join finds all pairs with Jaccard similarity of at least ``threshold``:

1. One pass makes each document's MinHash values and a 128-bit key of its shingle set. Documents with
   equal sets form a *class*; from here on a class is one row with its number of documents.
2. Classes that agree on a band of MinHash values share a bucket, and only classes of one bucket are
   compared. At similarity 0.8 a pair is missed by all BANDS bands with probability 5e-5, and less above. Of
   buckets with the same classes one is kept, and a pair belongs to its first shared band, so it is compared
   once.
3. A bucket is compared in blocks of about BLOCK classes and BLOCK_SHINGLES shingles a side, each pair of
   blocks a unit of its own, so a bucket of any size is spread over tasks and bounded in memory. Units hold
   MinHash values only (SKETCH_BYTES a class). They are compared CHUNK by CHUNK; a pair is dropped as soon as the
   posterior probability (uniform prior) that its similarity reaches the threshold is below TOLERANCE.
4. A class with pairs left in a unit comes with a bitmap of its partners there; only then are texts fetched,
   by row number, and the pairs verified exactly on their shingle sets.
5. A unit reports for each class the documents it is linked to, and a spanning forest of its links; final
   components follow from the forests. Pairs are never rows of a table, yet every link is counted.

Keys that hold many rows (a class with many copies, a bucket with many classes, a large component) are cut into
pieces in every join on them. The result reads the table of sketches in the shared folder, which therefore stays
until the caller deletes it; other intermediate tables are deleted.

Cases: a document without words (null, empty, only punctuation) has no links and is its own class; a null
id is kept, its class id is the least id of its component (null if all are); repeated rows are copies of
each other; ids may repeat, also with different texts; other columns don't matter, whatever their names; an empty
table gives an empty table.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, map_columns, ready, release, spread_join, written
from .graph import connected_components
from .textkit import HashTable, mix, ragged, slices, words

SHINGLE, BANDS, ROWS = 5, 25, 5
HASHES = BANDS * ROWS
CHUNK, TOLERANCE = 25, 1e-6
BLOCK, BLOCK_SHINGLES, TILE = 2048, 1 << 18, 256
VALUE_BYTES = 2
SKETCH_BYTES = VALUE_BYTES * HASHES


@lru_cache(maxsize=1)
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:HASHES] | np.uint64(1), x[HASHES:]


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the slice's shingles, and where each document's begin (one more entry than documents)."""
    h, _, _, first = words(data, offsets)
    count = np.diff(first)
    full = np.maximum(count - SHINGLE + 1, (count > 0).astype(np.int64))
    at = ragged(first[:-1], full)
    short = np.repeat(np.where(count < SHINGLE, count, SHINGLE), full)
    out = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        out *= np.uint64(0xC2B2AE3D27D4EB4F)
        out += np.where(k < short, h[np.minimum(at + k, max(len(h) - 1, 0))], np.uint64(k + 1)) if len(h) else np.uint64(0)
    return mix(out), np.concatenate([[0], np.cumsum(full)])


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As shingles, but each document's are distinct and sorted."""
    h, bound = shingles(data, offsets)
    doc = np.repeat(np.arange(len(bound) - 1), np.diff(bound))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(bound)))


def set_keys(h: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """A 128-bit key (two columns) of each document's set of distinct shingles; order doesn't matter."""
    out = []
    for salt in (0x8CB92BA72F3D8DD7, 0xAAAAAAAB55555555):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)), dtype=np.uint64)])
        out.append(mix(total[bound[1:]] - total[bound[:-1]] + np.diff(bound).astype(np.uint64)))
    return np.stack(out, 1)


def sketch(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """keep with key (16 bytes of the shingle set; null without words), sketch (HASHES MinHash values of 16 bits) and size (number of distinct shingles)."""
    ready(df.sparkSession)

    def make():
        a, b = _multipliers()

        def f(batch):
            for i, j, data, offsets in slices(batch.column(batch.schema.get_field_index(text_col))):
                h, bound = shingle_sets(data, offsets)
                some = np.flatnonzero(np.diff(bound) > 0)
                values = np.zeros((len(some), HASHES), np.uint16)
                if len(some):
                    at, work = bound[some], np.empty_like(h)
                    for k in range(HASHES):
                        np.bitwise_xor(h, b[k], out=work)
                        np.multiply(work, a[k], out=work)
                        # The least value of a long text has few bits left; all of them are mixed into 16.
                        values[:, k] = mix(np.minimum.reduceat(work, at)) >> np.uint64(48)
                keys = set_keys(h, bound).tobytes()
                raw, key, out = values.tobytes(), [None] * (j - i), [None] * (j - i)
                for k, row in enumerate(some.tolist()):
                    key[row] = keys[16 * row : 16 * row + 16]
                    out[row] = raw[SKETCH_BYTES * k : SKETCH_BYTES * (k + 1)]
                yield i, j, [pa.array(key, pa.binary()), pa.array(out, pa.binary()), pa.array(np.diff(bound).astype(np.int32))]

        return f

    return map_columns(df.select(*dict.fromkeys([*keep, text_col])), make, {"key": "binary", "sketch": "binary", "size": "int"}, keep)


@lru_cache(maxsize=8)
def least_matches(threshold: float) -> tuple[int, ...]:
    """After each CHUNK of hashes, the fewest matches with which a pair may still reach the threshold.

    With a uniform prior, P(similarity >= t | m of k match) is P(Binomial(k + 1, t) <= m)."""
    out = []
    for k in range(CHUNK, HASHES + 1, CHUNK):
        tail, m = 0.0, -1
        while tail < TOLERANCE:
            m += 1
            tail += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        out.append(m)
    return tuple(out)


def band_ids(values: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band of MinHash values (class, band)."""
    parts = values.reshape(len(values), BANDS, ROWS).astype(np.uint64)
    out = np.zeros((len(values), BANDS), np.uint64)
    for k in range(ROWS):
        out = (out + parts[:, :, k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def candidate_pairs(left: np.ndarray, right: np.ndarray, sizes: tuple[np.ndarray, np.ndarray], same: bool, band: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of left, row of right) whose first shared band is this one and that pruning leaves. left, right:
    MinHash values; sizes: of their shingle sets; same: the two are one block, and each pair is wanted once."""
    need, out = least_matches(threshold), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    a, b = band_ids(left), band_ids(right)
    for p in range(0, len(left), TILE):
        q = slice(p, p + TILE)
        alive = a[q, band, None] == b[None, :, band]
        for e in range(band):
            alive &= a[q, e, None] != b[None, :, e]
        if same:
            alive &= np.arange(p, p + len(alive))[:, None] < np.arange(len(right))[None, :]
        x, y = np.nonzero(alive)
        x += p
        small, large = np.minimum(sizes[0][x], sizes[1][y]), np.maximum(sizes[0][x], sizes[1][y])
        fits = small >= threshold * large - 1e-9
        x, y = x[fits], y[fits]
        count = np.zeros(len(x), np.int32)
        for k, least in enumerate(need):
            part = slice(k * CHUNK, (k + 1) * CHUNK)
            for r in range(0, len(x), 1 << 15):
                w = slice(r, r + (1 << 15))
                count[w] += (left[x[w], part] == right[y[w], part]).sum(1, dtype=np.int32)
            x, y, count = (v[count >= least] for v in (x, y, count))
        out.append((x, y))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def verified(x: np.ndarray, y: np.ndarray, sets, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (row of left, row of right) that reach the threshold. sets: (hashes, bounds) of left's and right's shingle sets."""
    (h, hb), (g, gb) = sets
    size_x, size_y = np.diff(hb)[x], np.diff(gb)[y]
    if not len(x):
        return x, y
    # The right side as a table of (shingle, row); the left sides' shingles are looked up in it.
    shingle = np.unique(g)
    rows = np.uint64(len(gb))
    table = HashTable(len(g))
    table.put(mix(np.searchsorted(shingle, g).astype(np.uint64) * rows + np.repeat(np.arange(len(gb) - 1), np.diff(gb)).astype(np.uint64) + np.uint64(1)), np.zeros(len(g), np.int32))
    place = np.minimum(np.searchsorted(shingle, h), len(shingle) - 1)
    place = np.where(shingle[place] == h, place, -1)
    ok = np.zeros(len(x), bool)
    total, p = np.cumsum(size_x), 0
    while p < len(x):
        q = max(p + 1, int(np.searchsorted(total, (total[p - 1] if p else 0) + (1 << 20), "right")))
        at = place[ragged(hb[x[p:q]], size_x[p:q])]
        pair = np.repeat(np.arange(q - p), size_x[p:q])
        known = at >= 0
        at, pair = at[known], pair[known]
        found = table.get(mix(at.astype(np.uint64) * rows + y[p:q][pair].astype(np.uint64) + np.uint64(1))) >= 0
        common = np.bincount(pair[found], minlength=q - p)
        ok[p:q] = common >= threshold * (size_x[p:q] + size_y[p:q] - common) - 1e-9
        p = q
    return x[ok], y[ok]


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least row that each of n rows is connected with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


UNIT = ["band", "bucket", "lo", "hi"]


def _by_unit(batches, one):
    """one(rows) of each unit's rows, which come together."""
    held, unit = [], None
    for batch in batches:
        for r in batch.to_pylist():
            now = (r["band"], r["bucket"], r["lo"], r["hi"])
            if now != unit:
                if held and (out := one(held)) is not None:
                    yield out
                held, unit = [], now
            held.append(r)
    if held and (out := one(held)) is not None:
        yield out
    held = batch = None
    release()


def _prune(units: DataFrame, threshold: float) -> DataFrame:
    """Of each unit the classes with pairs left: their side, place in their block, and a bitmap of partners' places in the other block."""

    def one(rows: list[dict]) -> pa.RecordBatch | None:
        lo, hi = rows[0]["lo"], rows[0]["hi"]
        rows.sort(key=lambda r: r["key"])
        sides = [[r for r in rows if r["block"] == k] for k in ((lo,) if lo == hi else (lo, hi))]
        if not all(sides):
            return None
        values = [np.frombuffer(b"".join(r["sketch"] for r in side), np.uint16).reshape(len(side), HASHES) for side in sides]
        sizes = [np.array([r["size"] for r in side], np.int64) for side in sides]
        x, y = candidate_pairs(values[0], values[-1], (sizes[0], sizes[-1]), lo == hi, rows[0]["band"], threshold)
        if not len(x):
            return None
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        own, first = np.unique(x, return_index=True)
        width = -(-len(sides[-1]) // 8) * 8
        maps = {}
        for k, some in zip(own.tolist(), np.split(y, first[1:]), strict=True):
            bits = np.zeros(width, np.uint8)
            bits[some] = 1
            maps[k] = np.packbits(bits).tobytes()
        if lo == hi:
            out = [(0, k, maps.get(k)) for k in np.unique(np.concatenate([x, y])).tolist()]
        else:
            out = [(0, k, maps[k]) for k in own.tolist()] + [(1, k, None) for k in np.unique(y).tolist()]
        chosen = [sides[side][k] for side, k, _ in out]
        columns = [pa.array([r[c] for r in chosen], t) for c, t in (("band", pa.int32()), ("bucket", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("key", pa.binary()), ("w", pa.int64()))]
        columns += [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, names=[*UNIT, "key", "w", "side", "place", "partners"])

    return units.mapInArrow(lambda batches: _by_unit(batches, one), "band int, bucket bigint, lo int, hi int, key binary, w bigint, side int, place int, partners binary")


def _verify(units: DataFrame, threshold: float) -> DataFrame:
    """(key, links, root) for the classes of each unit that have links in it, from _prune's rows with texts."""

    def one(rows: list[dict]) -> pa.RecordBatch | None:
        rows.sort(key=lambda r: (r["side"], r["place"]))
        h, bound = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        for _, _, data, offsets in slices(pa.array([r["text"] for r in rows], pa.string())):
            own, b = shingle_sets(data, offsets)
            h.append(own)
            bound.append(b[1:] + bound[-1][-1])
        h, bound = np.concatenate(h), np.concatenate(bound)
        side = np.array([r["side"] for r in rows])
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if rows[0]["lo"] == rows[0]["hi"] else 1))
        row_of = np.full(max(rows[k]["place"] for k in b.tolist()) + 1, -1)
        row_of[[rows[k]["place"] for k in b.tolist()]] = np.arange(len(b))
        xs, ys = [], []
        for k, r in enumerate(rows[: len(a)]):
            if r["partners"]:
                y = row_of[np.flatnonzero(np.unpackbits(np.frombuffer(r["partners"], np.uint8)))]
                xs.append(np.full(len(y), k))
                ys.append(y)
        x, y = np.concatenate(xs), np.concatenate(ys)

        def sets(which):
            size = np.diff(bound)[which]
            return h[ragged(bound[which], size)], np.concatenate([[0], np.cumsum(size)])

        x, y = verified(x, y, (sets(a), sets(b)), threshold)
        if not len(x):
            return None
        x, y = a[x], b[y]
        weight, links = np.array([r["w"] for r in rows], np.int64), np.zeros(len(rows), np.int64)
        np.add.at(links, x, weight[y])
        np.add.at(links, y, weight[x])
        root, some = _forest(len(rows), x, y), np.flatnonzero(links).tolist()
        columns = [pa.array([rows[k]["key"] for k in some], pa.binary()), pa.array(links[some]), pa.array([rows[root[k]]["key"] for k in some], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["key", "links", "root"])

    return units.mapInArrow(lambda batches: _by_unit(batches, one), "key binary, links bigint, root binary")


def _dealt(units: DataFrame) -> DataFrame:
    """A unit's rows together in one task."""
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return units.repartition(parts, *UNIT).sortWithinPartitions(*UNIT)


def _found_links(sketched: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(key, links, root): a row for each class and unit in which it has links."""
    spark = sketched.sparkSession
    part = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.col("sketch").substr(b * (VALUE_BYTES * ROWS) + 1, F.lit(VALUE_BYTES * ROWS)))
    banded = classes.select("key", "size", F.posexplode(part).alias("band", "part")).select("band", F.xxhash64("part").alias("bucket"), "key", "size")
    buckets = written(banded.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = written(spread_join(banded, buckets, ["band", "bucket"], "n", BANDS * classes.count()), "members")
    marks = F.bit_xor(F.xxhash64("key")).alias("m1"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("m2")
    units = members.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), *marks)
    units = units.groupBy("n", "m1", "m2").agg(F.min(F.struct("band", "bucket", "shingles")).alias("first"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("first.shingles") / BLOCK_SHINGLES)).cast("int")
    units = units.select("first.band", "first.bucket", "n", blocks.alias("blocks"))
    candidates = written(classes.join(members.select("key").distinct(), "key", "left_semi"), "candidates")
    sides = spread_join(members.select("band", "bucket", "key"), units, ["band", "bucket"], "n", members.count()).join(candidates.select("key", "w", "size", "sketch"), "key")
    sides = sides.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sides = sides.select("band", "bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "key", "w", "size", "sketch")
    left = _prune(_dealt(sides), threshold)
    # By row number, which no two rows share; the same way at every size.
    texts = sketched.select("row", "text").join(candidates.select("row", "key").hint("merge"), "row").select("key", "text")
    found = written(_verify(_dealt(left.join(texts, "key")), threshold), "links")
    dropped(spark, buckets, members, candidates)
    return found


def _classes(sketched: DataFrame, threshold: float) -> DataFrame:
    """(key, w, row, class_first, n_links): a row for each class. row is its representative's; class_first is the first document of its component."""
    spark = sketched.sparkSession
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))).alias("first")
    classes = sketched.where("key is not null").groupBy("key").agg(first, F.count("*").alias("w"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    classes = written(classes.withColumn("row", F.col("first.row")), "classes")
    found = _found_links(sketched, classes, threshold)
    components = written(connected_components(found.select(F.col("key").alias("a"), F.col("root").alias("b"))), "components")
    rooted = components.withColumnRenamed("node", "key").join(classes.select("key", "first"), "key")
    least = rooted.groupBy("root").agg(F.min("first").alias("class_first"), F.count("*").alias("n"))
    joined = spread_join(rooted.drop("first"), least, ["root"], "n", components.count()).select("key", "class_first")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    out = classes.drop("sketch", "size").join(joined, "key", "left").join(links, "key", "left")
    out = written(out.select("key", "w", "row", F.coalesce("class_first", "first").alias("class_first"), (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "outcome")
    dropped(spark, classes, found, components)
    return out


def _sketched(docs: DataFrame, text_col: str, id_col: str, keep: list[str]) -> DataFrame:
    """id, text, row (a number of its own), the sketch, and keep's columns as c0, c1, ..."""
    own = [F.col(c).alias(f"c{k}") for k, c in enumerate(keep)]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *own, F.monotonically_increasing_id().alias("row"))
    return written(sketch(rows, "text", rows.columns), "sketch")


def jaccard_join(docs: DataFrame, threshold: float = 0.8, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, class_id, n_links): one row for each row of docs.

    class_id is the least id among the documents connected by links; n_links is the number of other documents
    whose similarity with this one is at least threshold (copies of the document included)."""
    sketched = _sketched(docs, text_col, id_col, [])
    # Only classes with links take part in the last join; every other document stands alone.
    linked = _classes(sketched, threshold).where("n_links > 0").select("key", "w", "class_first", "n_links")
    out = spread_join(sketched.select("id", "row", "key"), linked, ["key"], "w", sketched.count(), "left")
    class_id = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("class_first.id"))
    return out.select(F.col("id").alias(id_col), class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def keep_one_of_each(docs: DataFrame, threshold: float = 0.8, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with one document of each class: the one with the least id, a null id counting as the greatest. Of a
    class's rows with the same id one stays; an id that stands for texts of several classes stays in each."""
    others = [c for c in docs.columns if c not in (text_col, id_col)]
    sketched = _sketched(docs, text_col, id_col, others)
    stay = _classes(sketched, threshold).where("row = class_first.row").select("row")
    gone = written(sketched.where("key is not null").select("row").join(stay, "row", "left_anti"), "gone")
    name = {id_col: "id", text_col: "text"} | {c: f"c{k}" for k, c in enumerate(others)}
    return sketched.join(gone, "row", "left_anti").select(*(F.col(name[c]).alias(c) for c in docs.columns))
