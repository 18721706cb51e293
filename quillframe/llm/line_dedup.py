"""Lines that many documents share, found with two Bloom filters and confirmed exactly.

Texts are split at \\n; a line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z in lower case.
A key of at least ``min_chars`` code points that stands in at least ``min_docs`` documents loses all its lines, but for
those in the largest doc_id that has it.  A null or empty text is one empty line.

1. Each task notes, for every key of a document, ``HASHES`` filter positions: those it saw once and those it saw again,
   each one only once, and sends them as sorted, packed numbers, block by block.  Where a block meets, a position seen once sets
   the first filter's bit and one seen again the second's.  Only the second is kept.  Its size follows the number
   of lines up to ``max_bits``, which bounds the broadcast; beyond that more lines are suspected, and the result is the same.
2. Lines whose positions are all set in the second filter are suspects.  Only they are shuffled: 128 bits of
   the key and the document, each pair once.  Counting them exactly finds the keys to drop and who keeps them.
3. Texts stream once more, past the sorted keys; no text is shuffled.  If the keys are more than a broadcast may hold, the
   suspects that are to go meet their documents by a join instead.

``min_docs`` below 2 is an error.  Rows of one id are one document, and have the same lines dropped; rows without id are one
document, too, and its id is smaller than any other.  Repeated rows are rewritten each.  An empty table gives an empty result.
Extra columns may have any name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from quillframe.llm.common import TEXT_ROWS, arrow_batches, materialise, small_side

MIN_CHARS, MIN_DOCS = 20, 3
HASHES = 2
BITS_PER_LINE = 8
MAX_BITS = 1 << 30
BLOCK_BITS = 1 << 20
#: Positions a task sorts at once.
HELD = 1 << 22
#: Keys to drop that may be broadcast: 24 bytes each.
MOST_KEYS = 2_000_000
NO_ID = -(1 << 63)
_SPACE = b" \t\n\x0b\x0c\r"
_WIDEST = 4  # bytes a code point


def line_key(line: bytes) -> bytes:
    """The key of a line in UTF-8: bytes.lower() changes A-Z only."""
    return line.strip(_SPACE).lower()


def _long(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= _WIDEST * min_chars or key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_chars)


def _digests(text: str | None, min_chars: int) -> dict[int, bytes]:
    """Digests of a text's long keys by line number."""
    lines = (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")
    return {i: xxh3_128_digest(k) for i, line in enumerate(lines) if len(line) >= min_chars and _long(k := line.strip(_SPACE), min_chars)}


def _as_numbers(digests: list[bytes]) -> np.ndarray:
    """[digest, half]: high and low 64 bits."""
    return np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)


def _positions(digests: list[bytes], bits: int) -> np.ndarray:
    """HASHES positions for each key."""
    h = _as_numbers(digests)
    step = h[:, 0] | np.uint64(1)
    return np.stack([(h[:, 1] + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(HASHES)], 1)


def filter_bits(lines: int, max_bits: int = MAX_BITS) -> int:
    """A power of two of at least BITS_PER_LINE bits a line, within the bound."""
    return min(max_bits, max(BLOCK_BITS, 1 << (BITS_PER_LINE * max(lines, 1) - 1).bit_length()))


def seen_twice(docs: DataFrame, bits: int, min_chars: int = MIN_CHARS) -> np.ndarray:
    """The second filter, of ``bits`` / 8 bytes."""

    def packed(found: list[np.ndarray]) -> pd.DataFrame:
        at, n = np.unique(np.concatenate(found), return_counts=True)
        block = (at // np.uint64(BLOCK_BITS)).astype(np.int64)
        edges = np.flatnonzero(np.diff(block, prepend=-1))
        inside = (at % np.uint64(BLOCK_BITS)).astype("<u4")
        split = lambda a: np.split(a, edges[1:])
        return pd.DataFrame({"block": block[edges], "once": [x.tobytes() for x in split(inside)], "again": [x[m > 1].tobytes() for x, m in zip(split(inside), split(n), strict=True)]})

    def positions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, held = [], 0
        for batch in batches:
            # Within a text one key counts once; two keys at one position count twice, which only adds suspects.
            digests = [d for t in batch["text"] for d in set(_digests(t, min_chars).values())]
            if digests:
                found.append(_positions(digests, bits).ravel())
                held += len(found[-1])
            if held > HELD:
                yield packed(found)
                found, held = [], 0
        if found:
            yield packed(found)

    def merge(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, twice = np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool)
        for part in parts:
            for raw, again in zip(part["once"], part["again"], strict=True):
                at = np.frombuffer(raw, "<u4")
                twice[at[once[at]]] = True
                twice[np.frombuffer(again, "<u4")] = True
                once[at] = True
        yield pd.DataFrame({"block": [key[0]], "twice": [np.packbits(twice, bitorder="little").tobytes()]})

    with arrow_batches(docs.sparkSession, TEXT_ROWS):
        told = docs.select("text").mapInPandas(positions, "block long, once binary, again binary").groupBy("block").applyInPandas(merge, "block long, twice binary")
        out = np.zeros(bits // 8, np.uint8)
        for row in told.toLocalIterator():
            at = row.block * BLOCK_BITS // 8
            out[at : at + BLOCK_BITS // 8] = np.frombuffer(row.twice, np.uint8)
    return out


def shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_bits: int = MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of suspects, each once, and (key, keeper) of the keys whose lines go; ``docs`` has doc_id and text."""
    if min_docs < 2:
        raise ValueError("min_docs is 2 at least: the filters tell what is seen twice")
    spark = docs.sparkSession
    lines = docs.agg(F.coalesce(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1), F.lit(0))).first()[0]
    bits = filter_bits(lines, max_bits)
    twice = spark.sparkContext.broadcast(seen_twice(docs, bits, min_chars))

    def suspects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap = twice.value
        for batch in batches:
            digests = [list(set(_digests(t, min_chars).values())) for t in batch["text"]]
            of = np.repeat(np.arange(len(batch)), [len(d) for d in digests])
            flat = [d for ds in digests for d in ds]
            if flat:
                at = _positions(flat, bits)
                hit = np.flatnonzero(((bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(1))
                yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[of[hit]], "key": [flat[i] for i in hit]})

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    with arrow_batches(spark, TEXT_ROWS):
        seen = materialise(rows.mapInPandas(suspects, "doc_id long, key binary").distinct(), "line-suspects")
    keys = seen.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keeper")).where(F.col("docs") >= min_docs)
    return seen, materialise(keys.select("key", "keeper"), "line-keys")


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_bits: int = MAX_BITS, most_keys: int = MOST_KEYS) -> DataFrame:
    """Every document without its shared lines: doc_id, n_lines, n_dropped, text."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    seen, keys = shared_lines(rows, min_chars, min_docs, max_bits)
    rows = rows.withColumn("own", F.coalesce("doc_id", F.lit(NO_ID)))
    n_keys = keys.count()
    if n_keys <= most_keys:
        told = keys.toPandas()
        halves = _as_numbers(told["key"].tolist())
        order = np.lexsort((halves[:, 1], halves[:, 0]))
        model = spark.sparkContext.broadcast((halves[order], told["keeper"].to_numpy(np.int64)[order]))

        def gone_lines(batch: pd.DataFrame) -> list[set[int]]:
            halves, keepers = model.value
            digests = [_digests(t, min_chars) for t in batch["text"]]
            out: list[set[int]] = [set() for _ in digests]
            flat = [d for ds in digests for d in ds.values()]
            if not flat or not len(keepers):
                return out
            of = np.repeat(np.arange(len(batch)), [len(d) for d in digests])
            line = np.fromiter((i for ds in digests for i in ds), np.int64, len(flat))
            asked, own = _as_numbers(flat), batch["own"].to_numpy(np.int64)[of]
            at = np.searchsorted(halves[:, 0], asked[:, 0])
            left = np.arange(len(flat))
            while len(left):  # a second round only for keys that share 64 bits
                left = left[at[left] < len(keepers)]
                left = left[halves[at[left], 0] == asked[left, 0]]
                same = halves[at[left], 1] == asked[left, 1]
                for i in left[same & (keepers[at[left]] != own[left])]:
                    out[of[i]].add(int(line[i]))
                left = left[~same]
                at[left] += 1
            return out

        joined = rows
    else:
        gone = seen.join(keys, "key").where("doc_id <> keeper").groupBy(F.col("doc_id").alias("own")).agg(F.collect_set("key").alias("gone"))
        # A document's shared lines are no more than its lines, so a list of them is bounded by its text.
        joined = rows.join(gone, "own", "left").select("doc_id", "text", "gone")

        def gone_lines(batch: pd.DataFrame) -> list[set[int]]:
            dropped = [frozenset() if g is None else {bytes(x) for x in g} for g in batch["gone"]]
            return [{i for i, d in _digests(t, min_chars).items() if d in g} if g else set() for t, g in zip(batch["text"], dropped, strict=True)]

    def drop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = defaultdict(list)
            for text, gone in zip(batch["text"], gone_lines(batch), strict=True):
                lines = (text or "").split("\n")
                out["n_lines"].append(len(lines))
                out["n_dropped"].append(len(gone))
                out["text"].append("\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else text or "")
            if out:
                yield pd.concat([batch[["doc_id"]].reset_index(drop=True).astype({"doc_id": "Int64"}), pd.DataFrame(out)], axis=1)

    return joined.mapInPandas(drop, "doc_id long, n_lines long, n_dropped long, text string")
