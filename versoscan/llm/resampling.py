"""Importance resampling towards a target distribution, on hashed word runs.

Features are the runs of one to three words of a text; a feature's bucket is its CRC-32 modulo the number of buckets.
A bucket's gain says how much more often the target uses it than the corpus; a document's weight is the sum of the
gains of its features, and a draw without replacement adds Gumbel noise from a hash of its id and keeps the highest.

CRC-32 is linear: without its initial value, the register after a message is the exclusive or of one value for each
byte, which depends on the byte and on its distance from the end only. A table of these values (256 bytes by ``BLOCK``
distances, built by rule) is looked up for all bytes of all features of a chunk at once, and ``bitwise_xor.reduceat``
folds each feature's span. What the initial value adds depends on the length only and has a table too. A feature
longer than BLOCK bytes is cut into blocks from its end, whose registers are folded from the first block on.

Defined results: a null text has no words, so no features and weight 0; a null doc_id draws its noise as an empty
string and stands before all others in ties; repeated rows count in the statistics each time and are drawn each for
itself (which of equal rows gets which rank is open); texts may have any length and words too; empty tables give an
empty result, an empty target gives gains against a uniform one; columns that are not asked for are left out.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versoscan.functions.numbering import numbered
from versoscan.llm import words as W
from versoscan.llm.shared import cut, table

BUCKETS, LONGEST_RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
BLOCK = 256  # bytes of a feature that are folded at once
BATCH = 1 << 15  # bytes of features that are looked up at once
POLYNOMIAL = 0xEDB88320
LETTER = np.arange(256)
LETTER = ((LETTER >= 0x30) & (LETTER <= 0x39)) | ((LETTER >= 0x61) & (LETTER <= 0x7A)) | (LETTER >= 0x80)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@functools.cache
def crc_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a byte adds to the register, at [distance from the end * 256 + byte]; the register that the initial value
    leaves after each number of bytes; and what BLOCK zero bytes make of each byte of a register, at [place, byte]."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, one >> np.uint32(1) ^ np.uint32(POLYNOMIAL), one >> np.uint32(1)).astype(np.uint32)
    zero_byte = lambda r: r >> np.uint32(8) ^ one[r & np.uint32(255)]
    rows, start = [one], [np.array([0xFFFFFFFF], np.uint32)]
    shifted = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32)[:, None] * np.uint32(8))
    for _ in range(BLOCK):
        rows.append(zero_byte(rows[-1]))
        start.append(zero_byte(start[-1]))
        shifted = zero_byte(shifted)
    return np.concatenate(rows[:BLOCK]), np.concatenate(start), shifted


def crc32_of_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32 of data[begin:end] for each span; empty spans have 0."""
    by_distance, initial, shifted = crc_tables()
    length = end - begin
    parts = np.maximum(-(-length // BLOCK), 1)  # blocks of each span, the first one may be shorter
    last = np.cumsum(parts)
    if len(parts) and parts.max() > 1:
        of = np.repeat(np.arange(len(parts)), parts)
        to = end[of] - (last[of] - 1 - np.arange(len(of))) * BLOCK
        block_begin, block_end = np.maximum(begin[of], to - BLOCK), to
    else:
        block_begin, block_end = begin, end
    raw = np.zeros(len(block_begin), np.uint32)
    size = block_end - block_begin
    total = np.cumsum(size)
    at = 0
    while at < len(raw):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BATCH, side="right")))
        full = np.flatnonzero(size[at:stop]) + at  # reduceat has no empty spans
        n = size[full]
        if len(full):
            first = np.cumsum(n) - n
            where = np.repeat((block_begin[full] - first).astype(np.int32), n)
            where += np.arange(len(where), dtype=np.int32)
            distance = np.repeat((block_end[full] - 1).astype(np.int32), n)
            distance -= where
            raw[full] = np.bitwise_xor.reduceat(by_distance[(distance << 8) | data[where]], first)
        at = stop
    head = last - parts
    register = raw[head] ^ initial[size[head]]
    rest = np.flatnonzero(parts > 1)
    for k in range(1, int(parts.max()) if len(rest) else 1):
        rest = rest[parts[rest] > k]
        r = register[rest]
        moved = shifted[0][r & np.uint32(255)]
        for place in range(1, 4):
            moved = moved ^ shifted[place][r >> np.uint32(8 * place) & np.uint32(255)]
        register[rest] = moved ^ raw[head[rest] + k]
    return register ^ np.uint32(0xFFFFFFFF)


def joined_words(words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' bytes with one space between, and where each word begins and ends there."""
    n = words.end - words.start
    end = np.cumsum(n + 1) - 1
    begin = end - n
    data = np.full(int(end[-1]) + 1 if len(end) else 0, 32, np.uint8)
    of = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(of)) - (np.cumsum(n) - n)[of]
    data[begin[of] + step] = words.data[words.start[of] + step]
    return data, begin, end


def feature_buckets(column: pa.Array, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> tuple[W.Words, list[tuple[np.ndarray, np.ndarray]]]:
    """The words of texts without nulls, and for each run length the first words of the runs and their buckets."""
    words = W.find_words(column, ~LETTER, LOWER)
    data, begin, end = joined_words(words)
    found = []
    for n in range(1, longest + 1):
        starts = W.windows(words, n)
        found.append((starts, (crc32_of_spans(data, begin[starts], end[starts + n - 1]) % np.uint32(buckets)).astype(np.int64)))
    return words, found


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> np.ndarray:
    """How many features of all rows of texts(text) fall into each bucket: ``buckets`` sums are all that leaves Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in W.chunks(batches):
            for _, found in feature_buckets(batch.column("text"), buckets, longest)[1]:
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of each bucket's smoothed share in the target over that in the corpus, floored."""
    t_all, s_all, n = float(target.sum()), float(corpus.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + n) / ((float(s) + 1) * (t_all + n)))) for t, s in zip(target, corpus, strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST_RUN) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row of docs(doc_id, text), in one narrow pass."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches):
            words, found = feature_buckets(batch.column("text"), buckets, longest)
            features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(2))
            for starts, bucket in found:
                of = words.text[starts]
                total = np.append(0, np.cumsum(gain[bucket]))
                first = np.searchsorted(of, np.arange(batch.num_rows + 1))
                features += np.diff(first)
                weight += total[first[1:]] - total[first[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(words.first)), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """A thousandth of a Gumbel variable in whole steps, from 32 bits of the id's hash."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of docs(doc_id, text); rank is null where the row
    is not drawn. Of the N rows with ``least_words`` or more, percent * N / 100 (floored) are drawn.

    Texts are read twice, once for the corpus's counts and once for the weights, and never shuffled. Only the numbers
    are dealt out by score.
    """
    gain = gains(bucket_counts(target, buckets, longest), bucket_counts(docs, buckets, longest))
    # read by the sampling of ranges and by the sort; a row holds numbers only
    scored = cut(weigh(docs, gain, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    can = F.col("n_words") >= least_words
    placed = numbered(scored.withColumn("_out", ~can), [F.col("_out"), F.desc("score"), F.col("doc_id")], "rank")
    drawn = placed.where(can).count() * percent // 100
    return placed.withColumn("rank", F.when(can & (F.col("rank") <= drawn), F.col("rank"))).drop("_out")


def resampling_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
