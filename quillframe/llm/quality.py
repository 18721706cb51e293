"""Quality rules: plain counts, and the perplexity of a modified Kneser-Ney n-gram model.

The model predicts the characters of a text from up to ``ORDER - 1`` before them, across word boundaries: every run of
white space, the end of a text included, is one space, and a text begins behind ``ORDER - 1`` start marks.  There are two
models a language (a null language is one, too, and the same as the empty one).  Each learns from half of the texts, by a hash of the
text, and scores the other half: so no document, nor a copy of it, foresees itself.  All documents that pass the plain rules
are learned from, with every word.  Tasks sort packed n-grams and send each once with its count; Spark sums the counts, derives the
continuation counts of lower orders, the three discounts of each order from its counts of counts, and the interpolated
probabilities.  The result is kept as arrays of sorted 64-bit hashes.

A document's log perplexity is the mean negative log probability of its symbols, words and the spaces behind them.  By mere
chance it strays from its language's median the less the longer the document is, so what is compared is the distance from the median times
the square root of the number of symbols.  A language's band lies ``BELOW`` and ``ABOVE`` times the distance of its quartiles outside
them; documents above are strange to their language, those below repeat its commonest parts.  Median and quartiles, a model's each, are
those of all different texts that pass the plain rules (copies count once, or a large group of them would leave no room for others),
read from exact counts of values rounded to ``STEP`` and ``DISTANCE_STEP``.  ``BELOW`` and ``ABOVE`` are the least whole numbers at
which a limit takes at most 0.5 % of the documents called good (quality 1) in one half of ``labels``, at sf 0.1; the other half
was in view when that share was chosen.  A document that the other half of its language has nothing to judge by has log perplexity 0 and is kept.

Size: every n-gram keeps its entry.  The sorted hashes are cut by their leading bits into parts of about ``PART_ROWS``
n-grams; the driver gathers and broadcasts a part at a time, and look-ups go part by part to workers that hold
``PARTS_KEPT`` parts at most and load others when asked.  A worker's memory grows with its longest text, by about 80 bytes a
character.

Words are ``[^\\x20\\x09-\\x0D]+``.  A null or empty text has no words, fails the base rules and has no perplexity.  Repeated
rows count as often as they stand there; ids, null or not, are only carried along.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.common import TEXT_ROWS, arrow_batches, forget_kept, give_back, materialise, small_side

ORDER = 5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Quartile distances between the quartiles and the limits below and above.
BELOW, ABOVE = 2.0, 6.0
STEP, DISTANCE_STEP = 0.001, 0.01
#: Quartiles are taken to lie at least so far apart.
LEAST_SPREAD = 0.3
#: N-grams of the model that the driver and a broadcast hold at a time, and the parts a worker keeps loaded.
PART_ROWS = 1_000_000
PARTS_KEPT = 12
#: Characters of a language that a task reads at once, symbols it packs at once, and n-grams it sums up before it sends them.
READ_CHARS, PACKED, HELD = 1 << 19, 1 << 20, 1_000_000
START = "\x02"
#: Stands between a language and the half of its texts that a model has learned.
MARK = "\x1f"
#: Packed n-grams give a character so many bits: its number in order of appearance in the task.
BITS = 12
_SPACES, _SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
_U = np.uint64
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


# ---- texts as arrays, and plain counts


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    return x ^ (x >> _U(29))


_ODD = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_ODD), -1, 1 << 64))
_IS_SYMBOL = np.isin(np.arange(128), [ord(c) for c in _SYMBOLS])
_powers_of: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    known = _powers_of.get(int(base))
    if known is None or len(known) < n:
        known = _powers_of[int(base)] = np.cumprod(np.concatenate([np.ones(1, _U), np.full(max(n, READ_CHARS), base, _U)]), dtype=_U)
    return known[:n]


class Texts:
    """Whole texts as one array of code points: ``pad`` start marks before each, and one space behind each word.

    ``codes``, ``event`` (False for the marks), ``sizes`` (symbols a text, marks included) and ``counts`` (a row of BASE each)."""

    def __init__(self, texts: list[str | None], pad: int = ORDER - 1):
        texts = [t or "" for t in texts]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + pad + 1
        codes = np.frombuffer("".join([START * pad + t + " " for t in texts]).encode("utf-32-le", "surrogatepass"), "<u4")
        first = np.cumsum(lengths) - lengths
        marks = (first[:, None] + np.arange(pad)).ravel()
        space = (codes == 32) | ((codes >= 9) & (codes <= 13))
        char = ~space
        char[marks] = False
        after = np.zeros_like(char)
        after[1:] = char[:-1]
        end = space & after
        event = char | end
        keep = event.copy()
        keep[marks] = True
        self.codes = np.where(space, np.uint32(32), codes)[keep]
        self.event = event[keep]
        per_text = lambda mask: np.add.reduceat(mask, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
        self.sizes = per_text(keep)
        n_words = per_text(end)
        symbols = _IS_SYMBOL[np.minimum(codes, 127)]
        repeated = self._repeated(codes, np.flatnonzero(char & ~after), np.flatnonzero(end), n_words)
        self.counts = np.stack([n_words, per_text(char), per_text(symbols), np.fromiter(map(dup_lines, texts), np.int64, len(texts)), repeated], 1)

    @staticmethod
    def _repeated(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """Words that stand in a 3-word window found twice or more in their text."""
        if len(starts) < 4:
            return np.zeros(len(n_words), np.int64)
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(_mixed(codes.astype(_U) + _ODD) * _powers(_ODD, len(codes)), dtype=_U)])
        h = _mixed((sums[ends] - sums[starts]) * _powers(_INVERSE, len(codes))[starts] + (ends - starts).astype(_U))
        text = np.repeat(np.arange(len(n_words), dtype=_U), n_words)
        windows = _mixed((h[:-2] * _ODD + h[1:-1]) * _ODD + h[2:] + text[2:] * _U(0xC2B2AE3D27D4EB4F))
        windows = np.where(text[2:] == text[:-2], windows, np.arange(len(windows), dtype=_U))  # apart from all others
        ordered = np.sort(windows)
        often = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        inside = np.zeros(len(h), bool)
        if len(often):
            at = np.flatnonzero(pd.Index(often).get_indexer(windows) >= 0)
            at = at[text[at + 2] == text[at]]
            for k in range(3):
                inside[at + k] = True
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(inside)])[np.concatenate([np.zeros(1, np.int64), np.cumsum(n_words)])]
        return np.diff(upto)


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    return len(lines) - len(set(lines))


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])


class Packer:
    """N-grams as numbers, BITS bits a character; a span of places with too many characters is halved until it fits."""

    def __init__(self, order: int = ORDER):
        if order * BITS > 63:
            raise ValueError("n-grams of this order don't fit a number")
        self.order, self.number, self.known = order, np.zeros(0x110000, np.uint16), [0]

    def room(self, codes: np.ndarray) -> bool:
        """Numbers new characters, unless there are too many."""
        number = self.number[codes]
        new = np.unique(codes[number == 0])
        if len(self.known) + len(new) > 1 << BITS:
            return False
        self.number[new] = np.arange(len(self.known), len(self.known) + len(new))
        self.known += new.tolist()
        return True

    def forget(self) -> None:
        self.number[:], self.known = 0, [0]

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """The n-gram that ends at each place from ``order - 1`` on."""
        ids, n = self.number[codes].astype(_U), len(codes) - self.order + 1
        out = ids[self.order - 1 :].copy()
        for k in range(1, self.order):
            out |= ids[self.order - 1 - k :][:n] << _U(BITS * k)
        return out

    def characters(self, keys: np.ndarray) -> np.ndarray:
        """[n-gram, place]: the code points."""
        known = np.array(self.known, np.uint32)
        return np.stack([known[(keys >> _U(BITS * k) & _U((1 << BITS) - 1)).astype(np.int64)] for k in range(self.order - 1, -1, -1)], 1)


# ---- counts and estimation


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")  # of two sorted runs: one merge
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([np.ones(1, bool), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n[order], first)


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, g, n: the n-grams of ``order`` characters of all documents (lang, text) to learn from."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_kept()
        packer, held = Packer(order), {}
        waiting: dict[str, list[str | None]] = defaultdict(list)
        sizes: dict[str, int] = defaultdict(int)

        def told() -> Iterator[pd.DataFrame]:
            for lang, (keys, n) in held.items():
                joined = packer.characters(keys).astype("<u4").tobytes().decode("utf-32-le", "replace")
                yield pd.DataFrame({"lang": lang, "g": [joined[i : i + order] for i in range(0, len(joined), order)], "n": n})
            held.clear()

        def read(lang: str) -> Iterator[pd.DataFrame]:
            texts = Texts(waiting.pop(lang), order - 1)
            sizes[lang] = 0
            kept = np.repeat(~base_failed(texts.counts), texts.sizes)
            codes, counted = texts.codes[kept], texts.event[kept]
            at = order - 1
            while at < len(codes):
                to = min(len(codes), at + PACKED)
                while not packer.room(codes[at - order + 1 : to]):
                    if len(packer.known) > 1:
                        yield from told()
                        packer.forget()
                    else:
                        to = at + max(1, (to - at) // 2)
                keys = np.sort(packer.keys(codes[at - order + 1 : to])[counted[at:to]])
                if len(keys):
                    first = np.flatnonzero(np.concatenate([np.ones(1, bool), keys[1:] != keys[:-1]]))
                    new = keys[first], np.diff(first, append=len(keys))
                    held[lang] = _summed(*map(np.concatenate, zip(held[lang], new, strict=True))) if lang in held else new
                    if sum(len(k) for k, _ in held.values()) > HELD:
                        yield from told()
                at = to

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                waiting[lang].append(text)
                sizes[lang] += len(text or "")
                if sizes[lang] > READ_CHARS:
                    yield from read(lang)
        for lang in list(waiting):
            yield from read(lang)
        yield from told()
        give_back()

    told = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), "text").mapInPandas(count, "lang string, g string, n long")
    return told.groupBy("lang", "g").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """(lang, g, logp) and (lang, g, log_weight): interpolated probabilities of n-grams, and what a context leaves to
    the next shorter one.  The n-gram "" stands for an unseen character, once the context "" has left it its share."""
    with arrow_batches(counts.sparkSession, TEXT_ROWS):
        counts = materialise(counts, "lm-counts")
    # A shorter n-gram counts the characters that stand before it: its extensions among all suffixes.
    suffixes = counts.select("lang", F.explode(F.array(*[F.substring("g", order + 1 - k, k) for k in range(2, order + 1)])).alias("s")).distinct()
    shorter = suffixes.groupBy("lang", F.expr("substring(s, 2)").alias("g")).agg(F.count(F.lit(1)).alias("a"))
    a = materialise(shorter.unionByName(counts.withColumnRenamed("n", "a")).withColumn("k", F.length("g")), "lm-adjusted")
    n = [F.count(F.when(F.col("a") == i, 1)).alias(f"n{i}") for i in range(1, 5)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    rule = [F.coalesce(F.when((F.col(f"n{i}") > 0) & (F.col("n1") > 0), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")), F.lit(0.5 * i)) for i in (1, 2, 3)]
    d = a.groupBy("lang", "k").agg(*n, F.count(F.lit(1)).alias("types"))
    d = materialise(d.select("lang", "k", "types", *[F.greatest(F.lit(0.05), F.least(r, F.lit(i - 0.05))).alias(f"d{i}") for i, r in enumerate(rule, 1)]), "lm-discounts")
    # Joined without a shuffle by language, as a language may hold most n-grams; a context has no more n-grams than characters follow it.
    a = a.join(small_side(d, d.count(), 80), ["lang", "k"]).withColumn("ctx", F.expr("substring(g, 1, k - 1)"))
    context = Window.partitionBy("lang", "ctx")
    discounted = F.col("a") - F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3"))
    a = a.withColumn("own", discounted / F.sum("a").over(context))
    a = a.withColumn("weight", F.greatest(F.lit(1e-9), 1 - F.sum("own").over(context)))
    a = materialise(a.select("lang", "g", "k", "types", "ctx", "own", "weight"), "lm-own")
    probabilities = {1: a.where("k = 1").select("lang", "g", (F.col("own") + F.col("weight") / (F.col("types") + 1)).alias("p"))}
    for k in range(2, order + 1):
        lower = probabilities[k - 1].select("lang", F.col("g").alias("suffix"), F.col("p").alias("shorter"))
        p = a.where(F.col("k") == k).withColumn("suffix", F.expr("substring(g, 2)")).join(lower, ["lang", "suffix"])
        probabilities[k] = materialise(p.select("lang", "g", (F.col("own") + F.col("weight") * F.col("shorter")).alias("p")), f"lm-p-{k}")
    unseen = d.where("k = 1").select("lang", F.lit("").alias("g"), (F.lit(1.0) / (F.col("types") + 1)).alias("p"))
    grams = reduce(DataFrame.unionByName, [unseen, *probabilities.values()])
    weights = a.groupBy("lang", F.col("ctx").alias("g")).agg(F.first("weight").alias("weight"))
    return grams.select("lang", "g", F.log("p").alias("logp")), weights.select("lang", "g", F.log("weight").alias("log_weight"))


# ---- the stored model


def _lang_salt(lang: str) -> np.uint64:
    return _U(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")) | 1)


def gram_hashes(characters: np.ndarray, salt: np.uint64) -> np.ndarray:
    """One hash a row of code points."""
    one = _mixed(characters.astype(_U) + _ODD)
    h = np.full(len(characters), 7, _U)
    for k in range(characters.shape[1]):
        h = h * _U(0x100000001B3) + one[:, k]
    return _mixed(h * salt + _U(characters.shape[1]))


class SortedPart:
    """Sorted hashes of n-grams and contexts that share ``lead`` leading bits, with their log probabilities and weights."""

    def __init__(self, grams: pd.DataFrame, contexts: pd.DataFrame, lead: int):
        self.lead = lead
        self.keys, self.logp = self._sorted(grams)
        self.contexts, self.weights = self._sorted(contexts)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    @staticmethod
    def _sorted(table: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        keys = table["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        return keys[order], table["value"].to_numpy(np.float32)[order]

    def find(self, name: str, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is there, and its value or 0.  Where hashes of the same bits behind the leading ones begin is
        kept, so a search takes a step or two."""
        keys, values = (self.keys, self.logp) if name == "grams" else (self.contexts, self.weights)
        if not len(keys):
            return np.zeros(len(asked), bool), np.zeros(len(asked))
        lead, bits = np.uint64(self.lead), max(4, int(len(keys)).bit_length() + 1)
        begins = self.__dict__.get("_" + name)
        if begins is None:
            begins = np.searchsorted(keys << lead, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)
            self.__dict__["_" + name] = begins
        last = len(keys) - 1
        at = np.minimum(begins[(asked << lead >> np.uint64(64 - bits)).astype(np.int64)], last)
        below = np.flatnonzero(keys[at] < asked)
        while len(below):
            at[below] += 1
            below = below[at[below] <= last]
            below = below[keys[at[below]] < asked[below]]
        at = np.minimum(at, last)
        hit = keys[at] == asked
        return hit, np.where(hit, values[at], 0.0)


class SortedModel:
    """The whole model: a broadcast for each of the 2 ** ``lead`` parts, of which a worker keeps ``kept`` loaded."""

    def __init__(self, parts: list[Broadcast], order: int, lead: int, kept: int):
        self.parts, self.order, self.lead, self.kept = parts, order, lead, kept

    def _loaded(self) -> list[int]:
        """As the broadcasts themselves know it: they outlive a task in its worker."""
        return [p for p, part in enumerate(self.parts) if "_value" in vars(part)]

    def _part(self, p: int) -> SortedPart:
        loaded = self._loaded()
        if p not in loaded and len(loaded) >= self.kept:
            vars(self.parts[loaded[-1]]).pop("_value")
        return self.parts[p].value

    def _find(self, name: str, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.lead:
            return self._part(0).find(name, asked)
        hit, values = np.zeros(len(asked), bool), np.zeros(len(asked))
        which = (asked >> np.uint64(64 - self.lead)).astype(np.int64)
        loaded = self._loaded()
        for p in sorted(np.unique(which).tolist(), key=lambda p: p not in loaded):
            at = np.flatnonzero(which == p)
            hit[at], values[at] = self._part(p).find(name, asked[at])
        return hit, values

    def logp(self, characters: np.ndarray, lang: str) -> np.ndarray:
        """The log probability of each row's last character behind the others."""
        salt, total, left = _lang_salt(lang), np.zeros(len(characters)), np.arange(len(characters))
        for k in range(self.order, -1, -1):
            if not len(left):
                break
            rows = characters[left, self.order - k :]
            hit, logp = self._find("grams", gram_hashes(rows, salt))
            total[left] += logp
            left = left[~hit]
            if k:
                total[left] += self._find("contexts", gram_hashes(rows[~hit, :-1], salt))[1]
        return total


def stored(probabilities: DataFrame, weights: DataFrame, order: int = ORDER) -> SortedModel:
    """Hashes are taken by the executors; one part at a time comes to the driver.  Contexts are no more than n-grams."""
    spark = probabilities.sparkSession
    lead = max(0, (probabilities.count() - 1) // PART_ROWS).bit_length()

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = batch["g"].str.len().to_numpy()
            keys = np.zeros(len(batch), _U)
            for (lang, k), rows in batch.groupby(["lang", lengths]).indices.items():
                codes = np.frombuffer("".join(batch["g"].iloc[rows]).encode("utf-32-le", "surrogatepass"), "<u4")
                keys[rows] = gram_hashes(codes.reshape(len(rows), int(k)), _lang_salt(lang))
            yield pd.DataFrame({"key": keys.view(np.int64), "value": batch["value"].to_numpy(np.float32)})

    def keyed(df: DataFrame, c: str) -> DataFrame:
        keys = df.select("lang", "g", F.col(c).alias("value")).mapInPandas(hashed, "key long, value float")
        # In the order of hashes, so that reading a part skips the row groups of others.
        return materialise(keys.repartitionByRange(1 << lead, "key").sortWithinPartitions("key"), "lm-keys") if lead else keys

    tables, parts = (keyed(probabilities, "logp"), keyed(weights, "log_weight")), []
    for p in range(1 << lead):
        least = p << 64 - lead
        least -= least >> 63 << 64  # as a signed number
        of = F.col("key").between(least, least + (1 << 64 - lead) - 1) if lead else F.lit(True)
        parts.append(spark.sparkContext.broadcast(SortedPart(*[t.where(of).toArrow().to_pandas() for t in tables], lead)))
    return SortedModel(parts, order, lead, PARTS_KEPT)


# ---- scores, bands and verdicts


def log_perplexities(texts: Texts, lang: str, model: SortedModel, packer: Packer) -> np.ndarray:
    """Of each text; NaN without a word."""
    codes, order = texts.codes, model.order
    value = np.zeros(len(codes))
    at = order - 1
    while at < len(codes):
        to = min(len(codes), at + PACKED)
        while not packer.room(codes[at - order + 1 : to]):
            if len(packer.known) > 1:
                packer.forget()
            else:
                to = at + max(1, (to - at) // 2)
        counted = np.flatnonzero(texts.event[at:to])
        told = pa.array(packer.keys(codes[at - order + 1 : to])[counted]).dictionary_encode()
        logp = model.logp(packer.characters(told.dictionary.to_numpy()), lang)
        value[at + counted] = logp[told.indices.to_numpy()]
        at = to
    sums = np.add.reduceat(value, np.cumsum(texts.sizes) - texts.sizes)
    events = texts.counts[:, 0] + texts.counts[:, 1]
    return np.where(events > 0, -sums / np.maximum(events, 1), np.nan)


def score(docs: DataFrame, model: SortedModel, id_col: str = "doc_id") -> DataFrame:
    """id, lang, h (a hash of the text), the plain counts and log_ppl of every document."""

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(model.order)
        for batch in batches:
            counts, ppl = np.zeros((len(batch), 5), np.int64), np.zeros(len(batch))
            lengths = batch["text"].str.len().fillna(0).to_numpy(np.int64)
            for lang, rows in batch.groupby("lang").indices.items():
                # At most READ_CHARS at a time, but for single texts that are longer.
                pieces = np.cumsum(lengths[rows]) // READ_CHARS
                for some in np.split(rows, np.flatnonzero(np.diff(pieces)) + 1):
                    texts = Texts(batch["text"].iloc[some].tolist(), model.order - 1)
                    counts[some], ppl[some] = texts.counts, log_perplexities(texts, lang, model, packer)
            told = pd.DataFrame(counts, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])
            told["log_ppl"] = pd.Series(ppl).astype(object).where(~np.isnan(ppl), None)
            yield pd.concat([batch[["id", "lang", "h"]].reset_index(drop=True), told], axis=1)
        give_back()

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce("lang", F.lit("")).alias("lang"), F.xxhash64("text").alias("h"), "text")
    kind = docs.schema[id_col].dataType.simpleString()
    scores = rows.mapInPandas(scored, f"id {kind}, lang string, h long, {BASE}, log_ppl double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return scores.withColumn("base_failed", failed)


def _distance() -> Column:
    return (F.col("log_ppl") - F.col("middle")) * F.sqrt(F.col("n_words") + F.col("word_chars"))


def _percentiles(values: DataFrame, value: Column, step: float, at: list[float]) -> DataFrame:
    """lang, q: exact but for rounding to ``step``."""
    bins = values.groupBy("lang", F.round(value / step).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bins.groupBy("lang").agg((F.percentile("bin", F.array(*map(F.lit, at)), F.col("n"))).alias("q")).select("lang", F.transform("q", lambda b: b * step).alias("q"))


def bands(scores: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """lang, middle, least, most: the median log_ppl and the limits of the scaled distance from it."""
    passed = scores.where("not base_failed and log_ppl is not null")
    texts = materialise(passed.groupBy("lang", "h").agg(*[F.min(c).alias(c) for c in ("log_ppl", "n_words", "word_chars")]), "lm-texts")
    middle = _percentiles(texts, F.col("log_ppl"), STEP, [0.5]).select("lang", F.col("q")[0].alias("middle"))
    middle = materialise(middle, "lm-medians")
    n = middle.count()
    quartiles = _percentiles(texts.join(small_side(middle, n, 64), "lang"), _distance(), DISTANCE_STEP, [0.25, 0.75])
    spread = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(LEAST_SPREAD))
    limits = quartiles.select("lang", (F.col("q")[0] - below * spread).alias("least"), (F.col("q")[1] + above * spread).alias("most"))
    return limits.join(small_side(middle, n, 64), "lang")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """Every document's counts and verdict: id_col, lang, n_words .. n_repeat_words, log_ppl, base_failed, lower, upper, kept."""
    half = F.pmod(F.xxhash64(F.coalesce(text_col, F.lit(""))), F.lit(2))
    named = lambda part: F.concat(F.coalesce(F.col(lang_col).cast("string"), F.lit("")), F.lit(MARK), part.cast("string"))
    taught = docs.select(named(half).alias("lang"), F.col(text_col).alias("text"))
    asked = docs.select(F.col(id_col).alias("doc_id"), named(1 - half).alias("lang"), F.col(text_col).alias("text"))
    model = stored(*kneser_ney(count_grams(taught, order), order), order)
    with arrow_batches(docs.sparkSession, TEXT_ROWS):
        scores = materialise(score(asked, model), "lm-scores")
    limits = materialise(bands(scores, below, above), "lm-bands")
    told = scores.join(small_side(limits, limits.count(), 80), "lang", "left").withColumn("lang", F.expr("left(lang, length(lang) - 2)"))
    scale = F.greatest(F.sqrt(F.col("n_words") + F.col("word_chars")), F.lit(1.0))
    told = told.withColumns({"lower": F.col("middle") + F.col("least") / scale, "upper": F.col("middle") + F.col("most") / scale})
    known = F.col("log_ppl").between(F.col("lower"), F.col("upper")) | (F.col("log_ppl") == 0)
    kept = F.coalesce(known, F.lit(False)) & ~F.col("base_failed")
    return told.drop("h", "middle", "least", "most").withColumn("kept", kept).withColumnRenamed("id", id_col)
