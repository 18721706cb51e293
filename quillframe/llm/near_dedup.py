"""Near-duplicates by HyperMinHash sketches, banding, estimates and exact confirmation.

A document's set: the hashes of its distinct n-word shingles, words being ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower
case; with fewer words than that, the whole sequence is one; without any the set is empty and linked with
nothing.  Documents are linked if 100 * intersection >= percent * union.

1. A sketch has ``REGISTERS`` registers of 16 bits: for the least hash of a bucket its count of leading zeros
   and ten bits of mantissa behind them; empty registers borrow from others by a fixed random order.  Documents
   of equal sets become one class, whose smallest id stands for it.
2. Bands of ``ROWS`` registers are hashed; classes that share one meet in a bucket.  The member with the most
   bucket mates becomes the bucket's pivot, and every other is paired with it only, so a bucket gives no more pairs than it
   has members, however large, and is never gathered in one task.
3. A pair goes on if the sketches' agreement, less that expected from chance collisions, is within ``MARGIN``
   standard errors of the threshold, and if the set sizes allow a link.  Then the full sets are compared.
4. Links found join classes into components.  Buckets that still hold several are drawn together into clusters, and in
   each every member outside the cluster's largest component is compared by full sets with all members of other
   components, through an index of the cluster's shingles.  Large clusters are dealt out in blocks of bounded
   size, and a task only reports links that join what it hadn't joined.

Every pair that shares a band is thus compared, ruled out by its sketch, or already joined by other links; a pair
at 0.85 shares none of the 32 bands with a chance below 1e-10, at 0.8 below 1e-7, and is ruled out by its sketch with one below
1e-9 in either case.

A null text is empty.  Rows of one id with different sets are different documents of one name; a component is named by the
smallest id in it, so such rows may be in several.  Rows without id are linked with nothing and stay.  Repeated rows
share their fate.  An empty table gives an empty result.  Only id and text are looked at; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import TEXT_ROWS, arrow_batches, give_back, kept_in_worker, materialise, small_side
from quillframe.operators.graph import linked_components

REGISTERS, ROWS, BANDS = 128, 4, 32
BUCKET_BITS, MANTISSA_BITS = 7, 10
WORDS, PERCENT = 5, 80
MARGIN = 7
#: Rows with whole sets that a Python worker gets at a time.
WIDE_ROWS = 200
#: Shingles of the members on either side of a block in step 4: a 64th of all, within these bounds.
LEAST_BLOCK, MOST_BLOCK = 20_000, 400_000

_U = np.uint64
_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ODD = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_ODD), -1, 1 << 64))
_BORROW = np.stack([_random.permutation(REGISTERS) for _ in range(REGISTERS)])  # [register, attempt]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]), dtype=np.uint64)


class Shingler:
    """Sorted shingle hashes of whole texts, many texts at a time."""

    def __init__(self, words: int):
        self.words, self.up, self.down = words, _powers(_ODD, 1 << 16), _powers(_INVERSE, 1 << 16)

    def word_hashes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All words' hashes, and how many each text has."""
        raws = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes.lower() is A-Z only
        joined = np.frombuffer(b" " + b" ".join(raws) + b" ", np.uint8)
        if len(joined) > len(self.up):
            self.up, self.down = _powers(_ODD, 2 * len(joined)), _powers(_INVERSE, 2 * len(joined))
        space = _SPACE[joined]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts, ends = edge[0::2], edge[1::2]
        # A word's polynomial, moved to power 0, from prefix sums; then its length is mixed in.
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[joined] * self.up[: len(joined)], dtype=np.uint64)])
        h = _mixed((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))
        text_ends = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1)
        upto = np.searchsorted(starts, text_ends, "right")
        return h, np.diff(upto, prepend=0)

    def sets(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        h, counts = self.word_hashes(texts)
        at, n = 0, self.words
        whole = _mixed(np.arange(1, n + 1, dtype=np.uint64))
        if len(h) >= n:
            rolled = np.zeros(len(h) - n + 1, np.uint64)
            for k in range(n):
                rolled = rolled * _ODD + h[k : len(h) - n + 1 + k]
            rolled = _mixed(rolled)
        for count in counts.tolist():
            if count >= n:
                yield np.unique(rolled[at : at + count - n + 1])
            elif count:
                one = whole[count : count + 1].copy()
                for x in h[at : at + count]:
                    one = one * _ODD + x
                yield _mixed(one)
            else:
                yield np.zeros(0, np.uint64)
            at += count


_LIMITS = np.arange(REGISTERS, dtype=np.uint64) << _U(64 - BUCKET_BITS)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a sorted, non-empty set."""
    first = np.searchsorted(hashes, _LIMITS)
    full = np.diff(first, append=len(hashes)) > 0
    out = np.zeros(REGISTERS, np.uint16)
    rest = hashes[first[full]] << _U(BUCKET_BITS)
    zeros = 64 - np.frexp((rest >> _U(11)).astype(float))[1].astype(np.int64) - 11
    zeros = np.minimum(zeros, 64 - BUCKET_BITS)
    mantissa = (rest << np.minimum(zeros + 1, 63).astype(np.uint64)) >> _U(64 - MANTISSA_BITS)
    out[full] = ((zeros + 1).astype(np.uint64) << _U(MANTISSA_BITS) | mantissa).astype(np.uint16)
    empty = np.flatnonzero(~full)
    for t in range(REGISTERS):
        if not len(empty):
            break
        donor = _BORROW[empty, t]
        found = full[donor]
        out[empty[found]] = out[donor[found]]
        empty = empty[~found]
    return out


def estimate(agree: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard from the share of equal registers, corrected for chance collisions of registers of sets of these sizes."""
    level = np.arange(64 - BUCKET_BITS)
    least = lambda n: np.diff((1 - 0.5 ** np.arange(65 - BUCKET_BITS))[None] ** np.maximum(n / REGISTERS, 1.0)[:, None], axis=1)
    chance = (least(n_a) * least(n_b))[:, level].sum(1) / (1 << MANTISSA_BITS)
    return (agree - chance) / (1 - chance)


def may_link(agree: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether a link of at least ``percent`` isn't ruled out by sketches and sizes."""
    j = percent / 100
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    error = np.sqrt(j * (1 - j) / np.minimum(REGISTERS, np.maximum(small, 1)))
    return (100 * small >= percent * large) & (estimate(agree, n_a, n_b) >= j - MARGIN * error)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _registers(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(-1, REGISTERS)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """id, text_hash, n, s1, s2 (which tell equal sets), regs of every row of ``docs`` (id, text)."""

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = kept_in_worker(f"shingler {words}", lambda: Shingler(words))
        for batch in batches:
            texts, out = batch["text"].tolist(), []
            for at in range(0, len(texts), 32):
                for s in shingler.sets(texts[at : at + 32]):
                    out.append((len(s), *_sums(s), sketch(s).astype("<u2").tobytes() if len(s) else b""))
            told = pd.DataFrame(out, columns=["n", "s1", "s2", "regs"])
            yield pd.concat([batch[["id", "text_hash"]].reset_index(drop=True).astype({"id": "Int64"}), told], axis=1)
        give_back()

    return docs.withColumn("text_hash", F.xxhash64("text")).mapInPandas(sketched, "id long, text_hash long, n long, s1 long, s2 long, regs binary")


def _sums(hashes: np.ndarray) -> tuple[int, int]:
    """Two sums that, with the size, tell sets apart."""
    return tuple(np.array([_mixed(hashes).sum(dtype=np.uint64), _mixed(hashes ^ _ODD).sum(dtype=np.uint64)]).view(np.int64).tolist())


def _sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, words: int, name: str) -> DataFrame:
    """node, hashes: the full sets of these classes only, from the rows that bear their ids."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = kept_in_worker(f"shingler {words}", lambda: Shingler(words))
        for batch in batches:
            texts, out = batch["text"].tolist(), []
            for at in range(0, len(texts), 32):
                out += [s for s in shingler.sets(texts[at : at + 32])]
            meant = [len(s) == n and _sums(s) == (s1, s2) for s, n, s1, s2 in zip(out, batch["n"], batch["s1"], batch["s2"], strict=True)]
            yield pd.DataFrame({"node": batch["node"], "hashes": [s.tobytes() for s in out]})[np.array(meant, bool)]
        give_back()

    wanted = materialise(nodes.distinct().join(classes.select("node", "id", "n", "s1", "s2"), "node"), f"near-wanted-{name}")
    rows = wanted.count()
    with arrow_batches(docs.sparkSession, WIDE_ROWS):
        sets = materialise(docs.join(small_side(wanted, rows, 64), "id").select("node", "n", "s1", "s2", "text").mapInPandas(made, "node long, hashes binary"), f"near-sets-{name}")
        # Repeats of a row give its set again.
        return sets if sets.count() == rows else materialise(sets.dropDuplicates(["node"]), f"near-sets-{name}")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The links among candidate pairs (a, b): by sketches, then by full sets."""

    def by_sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                agree = (_registers(batch["regs_a"]) == _registers(batch["regs_b"])).mean(1)
                batch = batch[may_link(agree, batch["n_a"].to_numpy(), batch["n_b"].to_numpy(), percent)]
            yield batch[["a", "b"]]

    def by_set(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch["set_a"], batch["set_b"], strict=True)]
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    side = lambda s: classes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("regs").alias(f"regs_{s}"))
    likely = materialise(pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(by_sketch, "a long, b long"), "near-likely")
    sets = _sets(likely.select(F.col("a").alias("node")).unionAll(likely.select(F.col("b").alias("node"))), classes, docs, words, "pairs")
    full = lambda s: sets.select(F.col("node").alias(s), F.col("hashes").alias(f"set_{s}"))
    with arrow_batches(docs.sparkSession, WIDE_ROWS):
        return materialise(likely.join(full("a"), "a").join(full("b"), "b").mapInPandas(by_set, "a long, b long"), "near-links")


def _block_links(percent: int):
    """Links between a block's probes and its indexed members, as far as they join different components."""

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("node", kind="stable", ignore_index=True)
        index, probes = block[~block["probe"]], block[block["probe"]]
        ids, roots, n = index["node"].to_numpy(), index["root"].tolist(), index["n"].to_numpy()
        hashes = np.frombuffer(b"".join(index["hashes"]), np.uint64)
        owners = np.repeat(np.arange(len(index)), n)
        order = np.argsort(hashes, kind="stable")
        hashes, owners = hashes[order], owners[order]
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while x in above:
                x = above[x]
            return x

        found = []
        for id_, root, size, raw in zip(probes["node"], probes["root"], probes["n"], probes["hashes"], strict=True):
            own = np.frombuffer(raw, np.uint64)
            lo, hi = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
            many = hi - lo
            at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
            shared = np.bincount(owners[at], minlength=len(index))
            for x in np.flatnonzero(100 * shared >= percent * (size + n - shared)):
                a, b = top(root), top(roots[x])
                if a != b:
                    above[max(a, b)] = min(a, b)
                    found.append((id_, ids[x]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return compare


def _rest_links(wide: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame | None:
    """Step 4, for the members (bkey, node, pivot, root, pivot_root, n) of buckets of three and more; None if all are joined."""
    apart = wide.where("root <> pivot_root").select("bkey").distinct()
    open_ = materialise(wide.join(apart, "bkey", "left_semi"), "near-open")
    if open_.isEmpty():
        return None
    clusters = materialise(linked_components(open_.select(F.col("node").alias("a"), F.col("pivot").alias("b")), "near-cluster").withColumnRenamed("id", "node"), "near-clusters")
    nodes = materialise(open_.select("node", "root", "n").distinct().join(clusters.select("node", F.col("root").alias("cluster")), "node"), "near-nodes")
    counts = nodes.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("members"))
    largest = counts.groupBy("cluster").agg(F.max(F.struct("members", (-F.col("root")).alias("first"))).alias("top"), F.count(F.lit(1)).alias("several")).where("several > 1")
    nodes = nodes.join(largest.select("cluster", (-F.col("top.first")).alias("main")), "cluster").withColumn("outside", F.col("root") != F.col("main"))
    block = min(MOST_BLOCK, max(LEAST_BLOCK, (nodes.agg(F.sum("n")).first()[0] or 0) // 64))
    blocks = nodes.groupBy("cluster").agg(F.ceil(F.sum("n") / block).alias("of_index"), F.ceil(F.sum(F.when(F.col("outside"), F.col("n"))) / block).alias("of_probes"))
    nodes = materialise(nodes.join(blocks, "cluster").join(_sets(nodes.select("node"), classes, docs, words, "clusters"), "node"), "near-cluster-sets")
    spread = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["cluster", "node", "root", "n", "hashes"]
    index = nodes.select(*columns, F.lit(False).alias("probe"), spread("of_index").alias("i"), each("of_probes").alias("p"))
    probes = nodes.where("outside").select(*columns, F.lit(True).alias("probe"), each("of_index").alias("i"), spread("of_probes").alias("p"))
    return materialise(index.unionByName(probes).groupBy("cluster", "i", "p").applyInPandas(_block_links(percent), "a long, b long"), "near-more-links")


def placed_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """id, text_hash, n and component of every row of ``docs`` (id, text)."""
    with arrow_batches(docs.sparkSession, TEXT_ROWS):
        told = materialise(sketches(docs, words), "near-sketches")
    named = told.where("n > 0 and id is not null")
    classes = named.groupBy("n", "s1", "s2").agg(F.min("id").alias("id"), F.first("regs").alias("regs"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    width = 2 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("regs", b * width + 1, F.lit(width))))
    bands = classes.select("node", F.explode(keys).alias("bkey"))
    shared = materialise(bands.groupBy("bkey").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "near-buckets")
    members = materialise(bands.join(small_side(shared, shared.count(), 32), "bkey"), "near-members")
    mates = members.groupBy("node").agg(F.sum("size").alias("mates"))
    ranked = members.join(mates, "node").select("bkey", "node", "size", F.struct("mates", (-F.col("node")).alias("first"), F.col("node").alias("pivot")).alias("rank"))
    pivots = materialise(ranked.groupBy("bkey").agg(F.max("rank").alias("top")).select("bkey", F.col("top.pivot").alias("pivot")), "near-pivots")
    starred = materialise(members.join(pivots, "bkey"), "near-starred")
    pairs = starred.where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    links = _confirmed(pairs, classes, docs, words, percent)
    roots = materialise(linked_components(links, "near-1").withColumnRenamed("id", "node"), "near-roots-1")
    # Buckets of three and more whose members are still apart; those of two were compared.
    wide = starred.where("size > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    pivot_roots = roots.select(F.col("node").alias("pivot"), F.col("root").alias("pivot_root"))
    wide = wide.join(pivot_roots, "pivot", "left").withColumn("pivot_root", F.coalesce("pivot_root", "pivot"))
    more = _rest_links(materialise(wide.join(classes.select("node", "n"), "node"), "near-wide"), classes, docs, words, percent)
    if more is not None:
        roots = materialise(linked_components(links.unionAll(more), "near-2").withColumnRenamed("id", "node"), "near-roots-2")
    # A component's name is the smallest id of its classes; only classes with a link have a root.
    linked_classes = roots.join(classes.select("node", "id"), "node")
    names = linked_classes.groupBy("root").agg(F.min("id").alias("name"))
    names = roots.join(names, "root").select("node", "name")
    named_classes = classes.select("n", "s1", "s2", "id", "node").join(names, "node", "left").select("n", "s1", "s2", F.coalesce("name", "id").alias("name"))
    placed = told.join(named_classes, ["n", "s1", "s2"], "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("id")))
    return placed.select("id", "text_hash", "n", component.alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Every row's component: id_col, n_shingles, component_id, kept."""
    placed = placed_rows(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), words, percent)
    told = placed.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return told.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the rows that have a smaller id in their component; all columns stay as they are."""
    placed = placed_rows(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), words, percent)
    gone = materialise(placed.where("component < id").select(F.col("id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct(), "near-gone")
    same = (docs[id_col].cast("long") == gone["gone_id"]) & (F.xxhash64(docs[text_col]) == gone["gone_hash"])
    return docs.join(small_side(gone, gone.count(), 32), same, "left_anti")
