"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton holds all substrings of a sample of its labelled text.  A document is parsed
against each into phrases, each the longest match from where the last one ended; a symbol the sample hasn't is a phrase of
its own.  The language that needs fewest phrases a symbol wins; equal costs go to the first language by code point.
A language with a small sample matches less and so needs more phrases.

Text is taken in lower case; all letters of the samples are symbols, letters in none of them are one more, and every run of
other characters is one gap.  Whole texts are parsed, in segments of ``SEGMENT`` symbols (and slices of ``SLICE`` characters)
at which a phrase ends for every language alike, so that many segments step through the automata at once and a
worker holds no more than a few slices' arrays.

Bounds: a language is learned from ``SAMPLE_DOCS`` labelled rows at most, whatever their length: the distinct ones with the least hashes
of id, language and text.  A row of up to ``ROW_CHARS`` characters is learned whole, a longer one by so many characters in pieces
of ``PIECE``, drawn by hash from all over it.  An automaton has fewer than twice as many states as its sample has symbols; its
table has ``HOT`` columns for the language's most frequent symbols, and a sorted list of the transitions by others.  Tasks build
the automata (small ones may share a task); the driver passes them on one by one, and a worker keeps ``KEPT`` of them loaded at most.

A text that is null or has no letter is ``und`` with score 0, as is every text if nothing is labelled.  Rows that repeat are
predicted each, and learned once; a null id is an id.  An empty table gives an empty result.  Labels, ids and sources never
enter a prediction.  Extra columns may have any name.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.common import materialise, small_side

SAMPLE_DOCS, ROW_CHARS, PIECE = 30, 8_000, 1_000
HOT, KEPT = 40, 8
SEGMENT, SLICE = 512, 1 << 21
UNKNOWN = "und"
GAP = 0
_FLAG, _MASK = np.int32(1 << 30), np.int32((1 << 30) - 1)


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """For each state its transitions; state 0 is the start."""
    length, link, moves = [0], [-1], [{}]
    last = 0
    for c in symbols:
        cur = len(length)
        length.append(length[last] + 1)
        link.append(0)
        moves.append({})
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                moves.append(dict(moves[q]))
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return moves


@lru_cache(maxsize=1)
def _all_letters() -> np.ndarray:
    return np.array([i for i in range(0x110000) if chr(i).isalpha()])


def letters_of(texts: Sequence[str]) -> list[str]:
    return sorted({c for t in texts for c in set(t.lower()) if c.isalpha()})


class Alphabet:
    """From characters to symbols: 0 a gap, then the letters, then one for all other letters, then padding."""

    def __init__(self, letters: list[str]):
        self.letters = letters
        self.other, self.padding = len(letters) + 1, len(letters) + 2
        self.table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}  # rebuilt where it is used

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All texts' symbols, their number and the number of letters in each."""
        if self.table is None:
            self.table = np.full(0x110000, GAP, np.int32)
            self.table[_all_letters()] = self.other
            for k, c in enumerate(self.letters, 1):
                self.table[ord(c)] = k
        lowered = [t.lower() for t in texts]
        sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
        all_ = self.table[np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")]
        starts = np.cumsum(sizes) - sizes
        keep = np.ones(len(all_), bool)
        keep[1:] = (all_[1:] != GAP) | (all_[:-1] != GAP)
        keep[starts[sizes > 0]] = True
        count = lambda m: np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(m)])[np.concatenate([starts, [len(all_)]])])
        return all_[keep], count(keep), count(all_ != GAP)


class Automaton:
    """One language's transitions, as tables that also say where to go on when a phrase ends.

    A row of ``hot`` has a column for each of the language's ``HOT`` most frequent symbols, one for all others, and one
    for padding; an entry is the offset of the next row, with a flag if a phrase ended before."""

    def __init__(self, learned: np.ndarray, symbols: int):
        moves = suffix_automaton(learned.tolist())
        often = np.argsort(-np.bincount(learned, minlength=symbols), kind="stable")[:HOT]
        self.column = np.full(symbols, HOT, np.int32)
        self.column[often] = np.arange(len(often))
        self.column[-1] = HOT + 1
        self.width, self.ended, self.symbols = HOT + 2, len(moves), symbols
        state = np.repeat(np.arange(len(moves)), [len(m) for m in moves])
        by = np.fromiter((c for m in moves for c in m), np.int64, len(state))
        to = np.fromiter((t for m in moves for t in m.values()), np.int64, len(state))
        hot = self.column[by] < HOT
        table = np.full((self.ended + 1, self.width), -1, np.int64)
        table[state[hot], self.column[by[hot]]] = to[hot] * self.width
        # One more state, in which a phrase begins with any symbol; a symbol the sample hasn't leads back to it.
        again = np.where(table[0] >= 0, table[0], self.ended * self.width) | _FLAG
        table = np.where(table >= 0, table, again)
        table[:, HOT + 1] = np.arange(self.ended + 1) * self.width
        self.table = table.astype(np.int32).ravel()
        keys = state[~hot] * symbols + by[~hot]
        order = np.argsort(keys)
        self.keys, self.to = np.append(keys[order], np.iinfo(np.int64).max), np.append(to[~hot][order], 0)

    def rare(self, offset: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """What ``hot`` would say for symbols without a column."""
        state = offset // self.width
        key = state * self.symbols + symbol
        at = np.searchsorted(self.keys, key)
        first = np.searchsorted(self.keys, symbol)
        anew = np.where(self.keys[first] == symbol, self.to[first], self.ended) * self.width | _FLAG
        return np.where(self.keys[at] == key, self.to[at] * self.width, anew).astype(np.int32)


def automaton(sample: str, alphabet: Alphabet) -> Automaton:
    return Automaton(alphabet.symbols([sample])[0], alphabet.padding + 1)


class CrossParser:
    """The automata of all languages, by order of the languages; those that are broadcasts are loaded when asked."""

    def __init__(self, langs: list[str], alphabet: Alphabet, automata: Sequence[Automaton | Broadcast], kept: int | None = None):
        self.langs, self.alphabet, self.automata, self.kept = langs, alphabet, automata, KEPT if kept is None else kept

    @classmethod
    def of(cls, samples: dict[str, str]) -> "CrossParser":
        """From the text of each language, here and now."""
        langs, alphabet = sorted(samples), Alphabet(letters_of([*samples.values()]))
        return cls(langs, alphabet, [automaton(samples[k], alphabet) for k in langs])

    def loaded(self) -> Iterator[Automaton]:
        for k, a in enumerate(self.automata):
            if isinstance(a, Broadcast):
                yield a.value
                if k >= self.kept:
                    vars(a).pop("_value")  # it stays on the executor's disk
            else:
                yield a

    def phrases(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """[text, language]: phrases of each text."""
        pieces = -(-sizes // SEGMENT)
        first = np.cumsum(pieces) - pieces
        starts = np.cumsum(sizes) - sizes
        grid = np.full(int(pieces.sum()) * SEGMENT, self.alphabet.padding, np.int32)
        grid[np.arange(len(symbols)) + np.repeat(first * SEGMENT - starts, sizes)] = symbols
        steps = np.ascontiguousarray(grid.reshape(-1, SEGMENT).T)
        out = np.zeros((len(sizes), len(self.langs)), np.int64)
        some = pieces > 0
        for k, a in enumerate(self.loaded()):
            at = np.full(steps.shape[1], a.ended * a.width, np.int32)
            ends = np.zeros(steps.shape[1], np.int32)
            columns = a.column[steps]
            with_rare = (columns == HOT).any(1)
            for step, column, mixed in zip(steps, columns, with_rare.tolist(), strict=True):
                if mixed:
                    rare = np.flatnonzero(column == HOT)
                    found = a.rare(at[rare], step[rare])
                np.add(at, column, out=at)
                a.table.take(at, out=at, mode="clip")
                if mixed:
                    at[rare] = found
                ends += at >> 30
                at &= _MASK
            if some.any():
                out[some, k] = np.add.reduceat(ends, first[some])
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        slices = [(i, t[k : k + SLICE]) for i, t in enumerate(texts) for k in range(0, len(t or ""), SLICE)]
        of, n = np.array([i for i, _ in slices], np.int64), len(texts)
        phrases, size, letters = np.zeros((n, len(self.langs)), np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        upto = np.cumsum([len(t) for _, t in slices]) // SLICE
        for some in np.split(np.arange(len(slices)), np.flatnonzero(np.diff(upto)) + 1) if slices else []:
            symbols, sizes, lettered = self.alphabet.symbols([slices[i][1] for i in some])
            np.add.at(phrases, of[some], self.phrases(symbols, sizes))
            np.add.at(size, of[some], sizes)
            np.add.at(letters, of[some], lettered)
        cost = phrases / np.maximum(size, 1)[:, None]
        best = cost.argmin(1)
        lowest = np.sort(cost, 1)
        score = np.ones(n) if len(self.langs) == 1 else 1 - lowest[:, 0] / np.maximum(lowest[:, 1], 1e-12)
        known = letters > 0
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)], np.where(known, score, 0.0)


def held_out(id_: Column) -> Column:
    """Documents kept from training: crc32 of the id as text leaves 2 when divided by 4; a null id is as an empty one."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def samples_of(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """lang, rank, text: what is learned, from (id, lang, text) rows with a language."""
    rows = labelled.where("lang is not null and text is not null")
    counts = materialise(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang-counts")
    h = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "lang", "text"), F.lit(1 << 40))
    # About twice as many as wanted, without a shuffle by language, as a language may have most rows; then the least of them.
    likely = rows.withColumn("h", h).join(small_side(counts, counts.count(), 64), "lang").where(F.col("h") * F.col("n") < F.lit(2.0 * sample_docs) * (1 << 40))
    places = F.sequence(F.lit(0), F.ceil(F.length("text") / PIECE).cast("int") - 1)
    drawn = F.slice(F.array_sort(F.transform(places, lambda i: F.struct(F.xxhash64("h", i).alias("by"), i.alias("i")))), 1, ROW_CHARS // PIECE)
    pieces = F.array_join(F.transform(drawn, lambda d: F.substr("text", d["i"] * PIECE + 1, F.lit(PIECE))), "\n")
    text = F.when(F.length("text") <= ROW_CHARS, F.col("text")).otherwise(pieces)
    ranked = likely.select("lang", "h", text.alias("text")).dropDuplicates(["lang", "h"]).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    return ranked.where(F.col("rank") <= sample_docs).select("lang", "rank", "text")


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> CrossParser:
    """Samples' letters come to the driver (Unicode has a bounded number), and each automaton on its way to a broadcast."""
    samples = materialise(samples_of(labelled, sample_docs), "lang-samples")

    def lettered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"letter": letters_of(batch["text"].tolist())}, dtype=object)

    letters = samples.select("text").mapInPandas(lettered, "letter string").distinct().collect()
    alphabet = Alphabet(sorted(r.letter for r in letters))

    def built(rows: pd.DataFrame) -> pd.DataFrame:
        sample = "\n".join(rows.sort_values("rank")["text"])
        return pd.DataFrame({"lang": rows["lang"].iloc[:1], "automaton": [pickle.dumps(automaton(sample, alphabet))]})

    automata = {}
    for r in samples.groupBy("lang").applyInPandas(built, "lang string, automaton binary").toLocalIterator():
        automata[r.lang] = labelled.sparkSession.sparkContext.broadcast(pickle.loads(r.automaton))
    langs = sorted(automata)
    return CrossParser(langs, alphabet, [automata[k] for k in langs])


def identify(docs: DataFrame, parser: CrossParser, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id_col, lang_pred and score."""

    def predicted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            langs, scores = parser.predict(batch["text"].tolist())
            yield pd.DataFrame({"id": batch["id"], "lang_pred": langs, "score": scores})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(predicted, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def language_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Trains on the labelled rows that aren't held out and predicts all: id_col, held_out, lang_pred, score."""
    labelled = docs.where(~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    told = identify(docs, train(labelled), id_col, text_col)
    return told.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
