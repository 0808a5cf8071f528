"""Token counts by a map-side two-tier lookup.

Tier 1 is a compact broadcast hash table from frequent pre-tokens to their numbers of tokens. A first pass counts the
pre-tokens of all texts, of at most PIECE_BYTES each: a task holds some HELD of them at a time and then hands their counts
on, so nothing is left out, and an exchange sums them. Sums have levels (eighths of a power of two); the table takes
whole levels from the top, as many as TABLE holds, so the driver takes TABLE * PIECE_BYTES bytes at most, from at most
TASKS tasks, and encodes each piece once. Tier 2: what the table misses is encoded exactly by each worker and kept in
its cache. Texts themselves are never shuffled; which pre-tokens are in tier 1 changes the speed, never a count.

Cases: null text counts as empty (no bytes, no tokens); repeated rows and other columns pass through; a
column with an output's name is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, load_spec
from .common import dropped, map_columns, ready, written
from .textkit import HashTable, pre_tokens, slices, span_hash

TASKS, HELD, TABLE, PIECE_BYTES = 16, 1 << 17, 1 << 16, 64


def frequent_pre_tokens(df: DataFrame, spec: bytes, text_col: str = "text") -> list[bytes]:
    """The most frequent pre-tokens of all texts, most frequent first; at most TABLE."""
    spark = ready(df.sparkSession)
    shared = spark.sparkContext.broadcast(spec)

    def run(batches):
        bpe = encoder(shared.value).bpe

        def handed_on():
            return pa.RecordBatch.from_arrays([pa.array(pieces, pa.binary()), pa.array(counts)], names=["piece", "n"])

        table, counts, pieces = HashTable(), np.zeros(0, np.int64), []
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                start, end, _ = pre_tokens(data, offsets, bpe.special)
                small = end - start <= PIECE_BYTES
                start, end = start[small], end[small]
                h = span_hash(data, start, end)
                at = table.get(h)
                miss = np.flatnonzero(at < 0)
                keys, first = np.unique(h[miss], return_index=True)
                table.put(keys, np.arange(len(pieces), len(pieces) + len(keys), dtype=np.int32))
                raw, new = data.tobytes(), miss[first]
                pieces += [raw[a:b] for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]
                at[miss] = table.get(h[miss])
                counts = np.append(counts, np.zeros(len(keys), np.int64)) + np.bincount(at, minlength=len(pieces))
                if len(pieces) > HELD:
                    yield handed_on()
                    table, counts, pieces = HashTable(), np.zeros(0, np.int64), []
        if pieces:
            yield handed_on()

    sums = df.select(text_col).mapInArrow(run, "piece binary, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    sums = written(sums.withColumn("level", F.floor(F.log2("n") * 8).cast("int")), "pre-tokens")
    lowest, size = 1 << 30, 0
    for level, n in sorted(sums.groupBy("level").count().collect(), reverse=True):
        if (size := size + n) > TABLE:
            break
        lowest = level
    top = sums.where(F.col("level") >= lowest).select("piece", "n").coalesce(TASKS).collect()
    dropped(spark, sums)
    return [bytes(p) for p, _ in sorted(top, key=lambda x: (-x[1], x[0]))]


def count_tokens(df: DataFrame, tokenizer_path: str, text_col: str = "text", limit: int = 1024, keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those in keep) with n_bytes, n_tokens and over_limit (n_tokens > limit) of each whole text."""
    spec = load_spec(tokenizer_path)
    top = frequent_pre_tokens(df, spec, text_col)
    own = encoder(spec)
    sizes = np.array([len(own.bpe.encode_piece(p)) for p in top], np.int32)
    raw = np.frombuffer(b"".join(top), np.uint8)
    end = np.cumsum([len(p) for p in top], dtype=np.int64)
    keys = span_hash(raw, end - np.array([len(p) for p in top], np.int64), end) if len(top) else np.zeros(0, np.uint64)
    shared = ready(df.sparkSession).sparkContext.broadcast((spec, keys, sizes))

    def make():
        spec, keys, sizes = shared.value
        enc, first_tier = encoder(spec), HashTable(max(16, len(keys)))
        first_tier.put(keys, sizes)

        def f(batch):
            for i, j, data, offsets in slices(batch.column(batch.schema.get_field_index(text_col))):
                start, end, first = pre_tokens(data, offsets, enc.bpe.special)
                h = span_hash(data, start, end)
                n = first_tier.get(h)
                miss = np.flatnonzero(n < 0)
                at = enc.entries(data, start[miss], end[miss], h[miss])
                n[miss] = enc.count[at]
                total = np.diff(np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[first])
                yield i, j, [pa.array(np.diff(offsets)), pa.array(total), pa.array(total > limit)]

        return f

    return map_columns(df, make, {"n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}, keep)
