"""Packing documents into sequences by the sum-of-squares rule.

Documents become token ids, each followed by an end token; only longer ones are cut, into pieces of a whole
sequence and a rest.  A piece goes where the sum over all gaps of the squared number of open sequences
with that gap becomes smallest, be it an open sequence or a new one; equal choices go to the smallest
gap.  Pieces come in descending length, which leaves the small ones to fill what stays open.

Each task packs one bucket of pieces.  Its ``carry`` emptiest sequences are opened again and their pieces
packed with those of other buckets, ``fan`` buckets a node, up to one; so sequences left open at the end of a
task do not add up, and no task holds more than a bucket or ``fan * carry`` sequences' pieces.

A null text is an empty one: just the end token.  Rows that repeat, or have no id, are packed each.  An empty table gives an
empty result.  Only the id and the text are looked at.
"""

from __future__ import annotations

import math
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import TEXT_ROWS, arrow_batches, give_back, kept_in_worker, materialise, number_repeats, row_part

SEQUENCE = 4096
END_ID = 1
LEAST_BUCKET_ROWS = 2_000
CARRY = 64
FAN = 4
#: Entries a worker keeps of its table from words to ids.
WORDS_KEPT = 800_000
#: Byte-level vocabularies write bytes that don't print as the characters from 256.
_PRINTING = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SYMBOLS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTING)}
_SPLIT = re.compile(r"[^ \t-\r]+")
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of whole texts by a tokenizer that drops white space and case, so that words are independent of
    each other; words once seen are looked up."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._check(path)
        self.known: dict[str, bytes] = {}
        self.marks = {m: array("I", self.tokenizer.encode(m, add_special_tokens=False).ids).tobytes() for m in ("", ".", ",", "!", "?")}

    def _check(self, path: str) -> None:
        """Words are independent only if the tokenizer drops white space and case, and splits off single marks."""
        encode = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        words = ["Plain", "words,", "stra\u00dfe.", "\u00c9t\u00e9!", "x1-y?"]
        if encode("\t".join(words) + " \n") != sum((encode(w.lower()) for w in words), []) or encode("ab.") != encode("ab") + encode("."):
            raise ValueError(f"{path}: not a tokenizer of lower-case words apart from white space")

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        for at in range(0, len(texts), 64):
            words = [_SPLIT.findall(t) for t in texts[at : at + 64]]
            self._learn(set().union(*words).difference(self.known))
            find = self.known.__getitem__
            for ws in words:
                yield b"".join(map(find, ws))

    def _learn(self, new: set[str]) -> None:
        """Words of letters go straight to the merges, behind what the tokenizer would do to them: lower case (but for
        the sigma, whose small form depends on its place) and bytes as symbols.  A mark behind the letters
        is a token of its own.  All other words take the tokenizer's whole way."""
        known, merge, other = self.known, self.tokenizer.model.tokenize, []
        for w in new:
            core, mark = (w[:-1], w[-1]) if w[-1] in ".,!?" else (w, "")
            if not core.isalpha() or "\u03a3" in core or not (low := core.lower()).isalpha() or not unicodedata.is_normalized("NFC", core):
                other.append(w)
                continue
            ids = known.get(low)
            if ids is None:
                symbols = low if low.isascii() else low.encode().decode("latin-1").translate(_SYMBOLS)
                known[low] = ids = array("I", [t.id for t in merge(symbols)]).tobytes()
            known[w] = ids + self.marks[mark]
        for w, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            known[w] = array("I", e.ids).tobytes()

    def forget(self) -> None:
        if len(self.known) > WORDS_KEPT:
            self.known.clear()


def word_tokenizer(path: str) -> WordTokenizer:
    """One a Python worker, kept from task to task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return kept_in_worker(path, lambda: WordTokenizer(path))


def cut(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32."""
    step, end = 4 * sequence, int(end_id).to_bytes(4, "little")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = word_tokenizer(vocabulary)
        for batch in batches:
            words.forget()
            rows = []
            for doc, ids in zip(batch["doc_id"], words.ids([t or "" for t in batch["text"]]), strict=True):
                ids += end
                rows += [(doc, k, k * sequence, min(step, len(ids) - k * step) // 4, zlib.crc32(ids[k * step : (k + 1) * step])) for k in range(-(-len(ids) // step))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(pieces, _PIECE)


def sum_of_squares(lengths: np.ndarray, capacity: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; the items come in the given order."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    to, at, bins = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    never = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        # What each choice adds to the sum: a bin leaves its gap, and joins the smaller one unless full.
        change = np.where(count[s:] > 0, 2 * count[: capacity + 1 - s] + 2 - 2 * count[s:], never)
        if count[s] > 0:
            change[0] = 1 - 2 * count[s]
        change[capacity - s] = 2 * count[capacity - s] + 1 if s < capacity else 0  # a new bin
        gap = s + int(change.argmin())
        if gap == capacity:
            b, bins = bins, bins + 1
        else:
            b = open_bins[gap].pop()
            count[gap] -= 1
        to[i], at[i] = b, capacity - gap
        if gap > s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return to, at


def _packer(sequence: int, carry: int, level: int, last: bool):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32", "nth"], ascending=[False, True, True, True, True], kind="stable", ignore_index=True)
        to, at = sum_of_squares(rows["length"].to_numpy(), sequence)
        fill = np.bincount(to, rows["length"], minlength=1)
        open_again = np.zeros(len(fill), bool)
        if not last:
            open_again[np.argsort(fill, kind="stable")[:carry]] = True
            open_again &= fill < sequence
        base = (level << 56) + (int(rows["bucket"].iloc[0]) << 24)
        return rows.assign(sequence_id=base + to, offset=at, settled=~open_again[to])

    return pack


def pack(pieces: DataFrame, sequence: int = SEQUENCE, carry: int = CARRY, fan: int = FAN, bucket_rows: int | None = None) -> DataFrame:
    """``pieces`` with sequence_id and offset, so that each sequence's pieces lie end to end from 0."""
    total = pieces.count()
    kind = pieces.schema["doc_id"].dataType
    # Ids pass Python as strings, as null ones would turn numbers into floats there; equal rows spread over buckets.
    pieces = materialise(pieces.select(F.col("doc_id").cast("string").alias("doc_id"), *pieces.columns[1:], row_part().alias("part")), "pack-rows")
    pieces = number_repeats(pieces, ["doc_id", "piece", "ids_crc32"]).drop("part")
    buckets = max(1, -(-total // (bucket_rows or max(LEAST_BUCKET_ROWS, math.isqrt(total)))))
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "nth"), F.lit(buckets)))
    schema = _PIECE.replace("doc_id long", "doc_id string") + ", nth long, bucket long, sequence_id long, offset long, settled boolean"
    done, level = [], 0
    while True:
        packed = materialise(rows.groupBy("bucket").applyInPandas(_packer(sequence, carry, level, buckets == 1), schema), f"pack-level-{level}")
        done.append(packed.where("settled").drop("settled", "bucket"))
        if buckets == 1:
            break
        rows, level, buckets = packed.where("not settled").drop("settled", "sequence_id", "offset"), level + 1, -(-buckets // fan)
        rows = rows.withColumn("bucket", F.floor(F.col("bucket") / fan).cast("long"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumn("doc_id", F.col("doc_id").cast(kind)).drop("nth")


def best_fit_pack(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Every piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    with arrow_batches(docs.sparkSession, TEXT_ROWS):
        pieces = materialise(cut(docs, vocabulary or vocabulary_path(), id_col, text_col, sequence, end_id), "pack-pieces")
    return pack(pieces, sequence)
