"""Target-distribution importance resampling over hashed n-grams.

A feature is a run of 1 .. ``max_words`` consecutive words, its bucket the CRC-32 of its UTF-8 bytes modulo ``buckets``.  The
CRC of each word is computed once; that of a longer run follows from its parts, crc(a + b) = shift(crc(a), len(b)) ^ crc(b), where
the shift by n zero bytes is a 32 x 32 matrix over GF(2), a product of the matrices of the powers of two in n.  No run is ever
built as a string.  A document weighs the floored mean of its features' gains, floor(1000 ln(p/q)) with add-one estimates p from
the target texts and q from the raw ones; Gumbel noise from a hash of its id makes the highest scores a draw without replacement.

Counts cover all texts.  Only the counts of ``buckets`` buckets reach the driver.  Ranks come from counts a score (a score is a whole
number of limited range), then from counts an id, so neither all rows nor equal rows are sorted in one task.

Null and empty texts have no feature: weight 0, never drawn.  Words of any length and texts of any length are read whole.  Rows are
documents: those with equal or null ids (null: the empty id) share their noise and take neighbouring ranks, nulls last among ties.
Empty tables give no rows; an empty target makes all gains follow from add-one estimates.  Other columns are not looked at."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillframe.llm.common import materialise, number_repeats, row_part, small_side

BUCKETS, MAX_WORDS, MIN_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7

#: The reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320

#: Texts are taken in slices of about so many bytes; longer words than LONG_WORD are hashed one by one.
SLICE_BYTES, LONG_WORD = 4 << 20, 64

#: Bytes of words (digits, letters, everything outside ASCII) in lower case, all others 0.
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
_SPACE = np.uint32(zlib.crc32(b" "))


def _zero_bit(v: np.ndarray) -> np.ndarray:
    return np.where(v & 1, (v >> 1) ^ np.uint32(POLYNOMIAL), v >> 1).astype(np.uint32)


def _times(columns: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The matrix with these 32 columns times each vector of bits."""
    out = np.zeros_like(v)
    for i, column in enumerate(columns):
        out ^= np.where(v >> np.uint32(i) & 1, column, 0).astype(np.uint32)
    return out


@functools.cache
def shift_matrix(k: int) -> np.ndarray:
    """Columns of the matrix that moves a CRC past 2**k zero bytes."""
    unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if k == 0:
        for _ in range(8):
            unit = _zero_bit(unit)
        return unit
    return _times(shift_matrix(k - 1), shift_matrix(k - 1))


@functools.cache
def _by_byte(k: int) -> np.ndarray:
    """``shift_matrix(k)`` times every value of each of the four bytes."""
    return np.stack([_times(shift_matrix(k), np.arange(256, dtype=np.uint32) << np.uint32(8 * b)) for b in range(4)])


@functools.cache
def _step() -> np.ndarray:
    v = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        v = _zero_bit(v)
    return v


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each CRC moved past its number of zero bytes."""
    out = crc.copy()
    for k in range(int(length.max(initial=0)).bit_length()):
        at = np.flatnonzero(length >> k & 1)
        v, table = out[at], _by_byte(k)
        out[at] = table[0][v & 255] ^ table[1][v >> 8 & 255] ^ table[2][v >> 16 & 255] ^ table[3][v >> 24]
    return out


def word_crcs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, crc, bytes) of every word, in order."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts) or not texts.buffers()[2]:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    word, edge = np.zeros(len(low) + 2, bool), np.zeros(len(low) + 1, bool)
    word[1:-1], edge[ends] = low > 0, True
    start = np.flatnonzero(word[1:-1] & (~word[:-2] | edge[:-1]))
    length = np.flatnonzero(word[1:-1] & (~word[2:] | edge[1:])) + 1 - start
    row = np.searchsorted(ends, start, side="right") - 1
    order = np.argsort(-length, kind="stable")
    at, left = start[order], length[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    n_long = int(np.searchsorted(-left, -LONG_WORD))
    for i in range(int(left[n_long:].max(initial=0))):
        here = slice(n_long, int(np.searchsorted(-left, -i)))
        crc[here] = _step()[(crc[here] ^ low[at[here] + i]) & 255] ^ (crc[here] >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(n_long):
        crc[i] = zlib.crc32(low[at[i] : at[i] + left[i]].tobytes())
    found = np.empty_like(crc)
    found[order] = crc
    return row, found, length


def features(texts: pa.Array, buckets: int = BUCKETS, max_words: int = MAX_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each feature, its bucket, words of each row)."""
    row, crc, length = word_crcs(texts)
    rows, found, run, own = [row], [crc], crc, row
    for more in range(1, max_words):
        whole = own[: len(own) - 1] == row[more:] if len(own) else own.astype(bool)
        last = np.flatnonzero(whole) + more
        # A run that crosses into the next row stays in the array, masked, so that positions keep their meaning.
        run = shifted(shifted(run[:-1], np.ones(len(run[:-1]), np.int64)) ^ _SPACE, length[more:]) ^ crc[more:] if len(run) else run
        own = np.where(whole, own[:-1], -1) if len(own) else own
        rows.append(row[last - more])
        found.append(run[last - more])
    return np.concatenate(rows), (np.concatenate(found) % np.uint32(buckets)).astype(np.int64), np.bincount(row, minlength=len(texts))


def _slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The texts from each start, about SLICE_BYTES at a time."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        done = size[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, done + SLICE_BYTES, side="right")))
        yield begin, texts.slice(begin, end - begin)
        begin = end


def bucket_counts(texts: Column, rows: DataFrame, buckets: int = BUCKETS, max_words: int = MAX_WORDS) -> DataFrame:
    """(bucket, n): features of all texts by bucket; each task hands on its sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part in _slices(batch.column(0)):
                total += np.bincount(features(part, buckets, max_words)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    return rows.select(texts.alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain from the counts of both sides."""
    n = len(raw)
    return np.floor(1000 * np.log((target + 1.0) * float(raw.sum() + n) / ((raw + 1.0) * float(target.sum() + n)))).astype(np.int64)


def _collected(counts: DataFrame, buckets: int) -> np.ndarray:
    found = np.zeros(buckets, np.int64)
    for bucket, n in counts.collect():  # one row a bucket
        found[bucket] = n
    return found


def _weigh(docs: DataFrame, gain: np.ndarray, max_words: int) -> DataFrame:
    """(id, n_words, n_features, weight) of (id, text)."""
    kind = docs.schema["id"].dataType
    arrow = to_arrow_type(kind)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for begin, part in _slices(batch.column(1)):
                row, bucket, words = features(part, len(gain), max_words)
                n = np.bincount(row, minlength=len(part))
                # Sums of whole numbers, exact as long as they stay below 2**53.
                total = np.bincount(row, weights=gain[bucket], minlength=len(part)).astype(np.int64)
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([ids.slice(begin, len(part)).cast(arrow), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(weigh, f"id {kind.simpleString()}, n_words long, n_features long, weight long")


def _ranked(scored: DataFrame, min_words: int, percent: int) -> DataFrame:
    """``scored`` with the rank of rows that are drawn, null for others."""
    able = scored.where(F.col("n_words") >= min_words)
    per_score = materialise(able.groupBy("score").agg(F.count(F.lit(1)).alias("n")), "importance-scores")
    draw = (per_score.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * percent) // 100
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)  # one row a score
    before = materialise(per_score.select("score", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above")).where(F.col("above") < draw), "importance-before")
    n_scores = before.count()
    lowest = before.agg(F.min("score")).first()[0]
    out = F.lit(None).cast("long")
    if lowest is None:
        return scored.withColumn("rank", out)
    taken = (F.col("n_words") >= min_words) & (F.col("score") >= lowest)
    rest = scored.where(~taken).withColumn("rank", out)
    some = number_repeats(scored.where(taken), ["score", "id"]).withColumn("no_id", F.col("id").isNull())
    per_id = scored.where(taken).groupBy("score", "id").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per_id = per_id.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(small_side(before, n_scores, 16), "score")
    per_id = per_id.select(F.col("score").alias("s"), F.col("id").alias("i"), F.col("id").isNull().alias("no_i"), (F.col("above") + F.col("earlier")).alias("place"))
    same = (F.col("score") == F.col("s")) & (F.col("no_id") == F.col("no_i")) & F.col("id").eqNullSafe(F.col("i"))
    told = some.join(per_id, same).withColumn("rank", F.col("place") + F.col("nth") + 1)
    return rest.unionByName(told.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))).select(*rest.columns))


def importance_draw(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT,
    min_words: int = MIN_WORDS, buckets: int = BUCKETS, max_words: int = MAX_WORDS, seed: int = SEED,
) -> DataFrame:
    """(id_col, n_words, n_features, weight, score, rank): ``percent`` of the documents of ``min_words`` words or more are drawn."""
    raw = _collected(bucket_counts(F.col(text_col), docs, buckets, max_words), buckets)
    wanted = _collected(bucket_counts(F.col(target_col), target, buckets, max_words), buckets)
    told = _weigh(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), gains(raw, wanted), max_words)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    noise = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log(noise))).cast("long")
    scored = materialise(told.withColumn("score", score).withColumn("part", row_part()), "importance-scored")
    return _ranked(scored, min_words, percent).select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
