"""Dense vectors (VEC, TOP, JOIN): exact neighbours and pairs over a metric index.

Blocks of the index that can't hold a result are ruled out by their distances to the pivots; each pair of blocks that is left, or a block
with the queries that visit it, is one matrix product in a task, which passes on only what can be in the result.  No product of all rows is ever a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.operators.metric import BLOCK_ROWS, Index, Space, matrix, small
from quillframe.scratch import materialise

#: Half of the last decimal that cosines are rounded to: what rounds up to a threshold is compared.
_ROUNDING = 5e-7
#: Blocks of a group, blocks of a group of a search over many blocks at most, and pairs that are confirmed at a time.
GROUP_BLOCKS, MOST_BLOCKS, _CONFIRM = 8, 32, 50_000


def _matrix(column: pd.Series) -> np.ndarray:
    return matrix(column, max(map(len, column), default=0))


def similar_pairs(vectors: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS, pivots: int | None = None, links: DataFrame | None = None, index: Index | None = None) -> DataFrame:
    """(a, b, cos) for all pairs a < b of (id, vec, grp) with another group and cos >= threshold, rounded to 6.

    With ``links`` (src, tgt), few for each src, pairs of one group come as well, and (same, linked) say whether a pair is of one group and whether
    either end links to the other: a task knows both, so pairs needn't be joined with anything."""
    index = index or Index(vectors, block_rows, pivots)
    pairs = materialise(index.block_pairs(threshold - _ROUNDING), "vector-block-pairs")
    space, number = index.space, index.number
    # Groups of blocks of which any pair may hold a result; tasks skip the other pairs of blocks in them.
    group = lambda c: F.floor(number(F.col(c)) / GROUP_BLOCKS).cast("int")
    tiles = materialise(pairs.select(F.least(group("left"), group("right")).alias("lg"), F.greatest(group("left"), group("right")).alias("rg")).distinct(), "vector-tiles")
    rows = index.rows.select("id", "vec", "grp", "block", group("block").alias("g"))
    # Renamed, so that the two sides of a pair are tables of their own.
    names = ["lg", "rg", "id", "vec", "grp", "block"]
    told = links is not None
    if told:
        rows = materialise(rows.join(links.groupBy(F.col("src").alias("id")).agg(F.collect_list("tgt").alias("to")), "id", "left"), "vector-links")
        names.append("to")
    left = rows.join(small(tiles, 16), F.col("g") == F.col("lg")).select(*names).toDF(*names)
    right = rows.join(small(tiles, 16), F.col("g") == F.col("rg")).select(*names).toDF(*names)
    reach = float(np.sqrt(max(0.0, 2 * space.top - 2 * (threshold - _ROUNDING))) + space.slack)
    kind = np.float32 if space.top < 1e30 else np.float64
    least = kind(threshold - 2 * _ROUNDING - (space.width + 4) * 2.0**-23 * space.top)

    def blocks(side: pd.DataFrame) -> list[tuple]:
        out = []
        for name, rows in side.groupby("block", sort=True):
            own = matrix(rows["vec"], space.width)
            d = space.indexed(own)
            out.append((name, rows["id"].to_numpy(), rows["grp"].to_numpy(), own, own.astype(kind), d.min(axis=0), d.max(axis=0)))
        return out

    def compare(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, bool)], [np.zeros(0, bool)]
        one, other = blocks(left), blocks(right)
        linked = _Links([left, right]) if told else None
        for an, a, ag, av, ak, alo, ahi in one:
            for bn, b, bg, bv, bk, blo, bhi in other:
                if (key[0] == key[1] and an > bn) or np.maximum(alo - bhi, blo - ahi).max() > reach:
                    continue
                at = np.flatnonzero(ak @ bk.T >= least)
                for x in range(0, len(at), _CONFIRM):
                    i, j = at[x : x + _CONFIRM] // len(b), at[x : x + _CONFIRM] % len(b)
                    cos = np.round(np.einsum("ij,ij->i", av[i], bv[j]), 6)
                    same = ag[i] == bg[j]
                    ok = (cos >= threshold) & (~same | told) & (a[i] < b[j] if an == bn else a[i] != b[j])
                    x_, y_ = np.minimum(a[i], b[j])[ok], np.maximum(a[i], b[j])[ok]
                    for to, some in zip(found, (x_, y_, cos[ok], same[ok], linked.between(x_, y_) if linked else same[ok]), strict=True):
                        to.append(some)
        return pd.DataFrame(dict(zip(names_out, map(np.concatenate, found[: len(names_out)]), strict=True)))

    kinds = "a long, b long, cos double" + (", same boolean, linked boolean" if told else "")
    names_out = [c.split()[0] for c in kinds.split(", ")]
    return left.groupBy("lg", "rg").cogroup(right.groupBy("lg", "rg")).applyInPandas(compare, kinds)


class _Links:
    """The links of these rows (id, to), as numbers of pairs in order."""

    def __init__(self, sides: list[pd.DataFrame]):
        self.ids = np.unique(np.concatenate([s["id"].to_numpy(np.int64) for s in sides]))
        ends = [(i, t) for s in sides for i, to in zip(s["id"], s["to"], strict=True) if to is not None for t in to]
        src, tgt = np.array(ends, np.int64).reshape(-1, 2).T
        here = np.isin(tgt, self.ids)
        self.pairs = np.unique(self._number(np.minimum(src, tgt)[here], np.maximum(src, tgt)[here]))

    def _number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, a) * len(self.ids) + np.searchsorted(self.ids, b)

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a links to b or b to a, for a < b of these rows."""
        return np.isin(self._number(a, b), self.pairs)


class _Hits:
    """The k best hits (query, id, grp, cos) of a chunk of queries so far, and each query's bound: a hit must reach it."""

    def __init__(self, frame: pd.DataFrame, least: np.ndarray, space: Space, k: int, same_group: str, positive: bool):
        self.ids, self.grp, self.bound = frame["qid"].to_numpy(), frame["grp"].to_numpy(), least
        self.own = matrix(frame["vec"], space.width)
        self.k, self.other, self.positive = k, same_group == "other", positive
        square = (self.own**2).sum(axis=1)
        self.reach = lambda: float(np.sqrt(max(0.0, (square + space.top - 2 * (self.bound - _ROUNDING)).max())) + space.slack)
        # Single precision rules pairs out, by more than it can be wrong; doubles decide on those that are left.
        size = np.sqrt(space.top * square.max(initial=0))
        self.kind = np.float32 if max(space.top, square.max(initial=0)) < 1e30 else np.float64
        self.off = (space.width + 4) * 2.0**-23 * size + 2 * _ROUNDING
        self.found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]

    def meet(self, ids: np.ndarray, grp: np.ndarray, own: np.ndarray) -> None:
        cos = self.own.astype(self.kind) @ own.astype(self.kind).T
        limit = self.bound - self.off
        new = np.flatnonzero(np.isneginf(self.bound))
        if len(new):
            c = cos[new]
            c[self._out(new[:, None], ids[None], grp[None])] = -np.inf
            if self.k < len(ids):
                limit[new] = np.partition(c, -self.k, axis=1)[:, -self.k].astype(float) - 2 * self.off
        at = np.flatnonzero(cos >= limit[:, None].astype(self.kind))
        i, j = at // len(ids), at % len(ids)
        able = ~self._out(i, ids[j], grp[j])
        i, j = i[able], j[able]
        exact = [np.einsum("ij,ij->i", self.own[i[x : x + _CONFIRM]], own[j[x : x + _CONFIRM]]) for x in range(0, len(i), _CONFIRM)]
        score = np.round(np.concatenate(exact), 6) if exact else np.zeros(0)
        able = (score >= self.bound[i]) & (score > (0 if self.positive else -np.inf))
        if not able.any():
            return
        i, ids_, grp_, score = (np.concatenate([old, x]) for old, x in zip(self.found, (i[able], ids[j[able]], grp[j[able]], score[able]), strict=True))
        order = np.lexsort((ids_, -score, i))
        i = i[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        kept = order[place < self.k]
        last = order[place == self.k - 1]
        self.found = [np.sort(i[place < self.k]), ids_[kept], grp_[kept], score[kept]]
        self.bound[i[place == self.k - 1]] = score[last]

    def _out(self, i: np.ndarray, ids: np.ndarray, grp: np.ndarray) -> np.ndarray:
        out = self.ids[i] == ids
        return out | (self.grp[i] == grp) if self.other else out

    def frame(self) -> pd.DataFrame:
        i, ids, grp, score = self.found
        return pd.DataFrame({"qid": self.ids[i], "id": ids, "grp": grp, "cos": score})


_NO_HITS = {"qid": [], "id": [], "grp": [], "cos": []}


def top_k(queries: DataFrame, vectors: DataFrame, k: int, same_group: str = "any", positive: bool = True, block_rows: int = BLOCK_ROWS, pivots: int | None = None, index: Index | None = None) -> DataFrame:
    """(qid, id, grp, cos, rank): each query's k nearest of ``vectors`` (id, vec, grp), itself left out.

    ``same_group``: "any", or "other" to leave out the query's own group before k is taken.  Ties go to the smaller id.
    Each query looks at the block it would be in first; its k-th best there bounds how far it has to look.  Then groups of
    GROUP_BLOCKS blocks (of up to MOST_BLOCKS where there are more than sixteen groups) meet: a task holds a group of queries and one of vectors, skips pairs of blocks that the bounds rule out, and hands
    on the k best of each query.  So a row travels once for each group, not for each block, and no (query, block) is a row."""
    index = index or Index(vectors, block_rows, pivots)
    space, any_ = index.space, index.n > 0
    n_blocks = sum(index.many)
    group_blocks = max(GROUP_BLOCKS, min(MOST_BLOCKS, n_blocks // 16))
    # Cells without vectors are nobody's home.
    empty = np.array([index.counts.get(j, 0) == 0 for j in range(len(index.many))])
    number = index.number

    def homes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            d = space.queries(matrix(frame["vec"], space.width)) if any_ else np.zeros((len(frame), 1))
            d[:, empty] = np.inf
            yield frame.assign(cell=d.argmin(axis=1).astype(np.int32))

    kinds = ", ".join(f"{n} {queries.schema[c].dataType.simpleString()}" for n, c in (("qid", "id"), ("vec", "vec"), ("grp", "grp")))
    q = queries.select(F.col("id").alias("qid"), "vec", "grp").mapInPandas(homes, f"{kinds}, cell int")
    many = F.element_at(F.array(*map(F.lit, index.many)), F.col("cell") + 1)
    q = materialise(q.withColumn("home", F.col("cell").cast("long") * (1 << 32) + F.pmod(F.xxhash64("qid"), many)).withColumn("home", number(F.col("home")).cast("long")).drop("cell"), "vector-queries")
    v = index.rows.select("id", "vec", "grp", number(F.col("block")).cast("long").alias("block"))
    r = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("cos"), "id")).cast("long")

    def cut(table: DataFrame, by: str, most: int) -> DataFrame:
        """(by, parts): in how many parts of ``most`` rows each is taken."""
        return materialise(table.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts")), "vector-parts")

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(_NO_HITS)
        own = matrix(right["vec"], space.width)
        ids, grp, blocks = right["id"].to_numpy(), right["grp"].to_numpy(), []
        for at in right.groupby("block", sort=True).indices.values():
            d = space.indexed(own[at])
            blocks.append((at, d.min(axis=0), d.max(axis=0)))
        found = []
        for _, rows in left.groupby("home", sort=True):
            for at in range(0, len(rows), block_rows):
                some = rows.iloc[at : at + block_rows]
                hits = _Hits(some, some["least"].to_numpy(float, copy=True), space, k, same_group, positive)
                e = space.queries(hits.own)
                low, high = e.min(axis=0), e.max(axis=0)
                gaps = [float(np.maximum(lo - high, low - hi).max()) for _, lo, hi in blocks]
                for x in np.argsort(gaps, kind="stable"):
                    if gaps[x] > hits.reach():
                        break
                    hits.meet(ids[blocks[x][0]], grp[blocks[x][0]], own[blocks[x][0]])
                found.append(hits.frame())
        return pd.concat(found)

    def compared(asked: DataFrame, held: DataFrame, of: str) -> DataFrame:
        """Queries (qid, vec, grp, home, least) beside the vectors that they are to meet, by ``of`` and part."""
        asked, held = asked.toDF(*asked.columns), held.toDF(*held.columns)
        return asked.groupBy(*of).cogroup(held.groupBy(*of)).applyInPandas(nearest, "qid long, id long, grp long, cos double")

    none = F.lit(float("-inf"))
    if n_blocks == 1:
        parts = cut(q, "home", block_rows)
        asked = q.withColumn("least", none).join(small(parts, 16), "home").withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int"))
        held = v.join(small(parts.withColumnRenamed("home", "block"), 16), "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return compared(asked, held, ["part"]).withColumn("rank", r).where(F.col("rank") <= k)
    parts = cut(q, "home", block_rows)
    asked = q.withColumn("least", none).join(small(parts, 16), "home").withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int")).withColumn("of", F.col("home"))
    held = v.join(small(parts.withColumnRenamed("home", "block"), 16), "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("of", F.col("block"))
    first = materialise(compared(asked, held, ["of", "part"]), "vector-first")
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("cos"), "id")))
    least = ranked.where(F.col("r") == k).select("qid", F.col("cos").alias("least"))
    bounded = q.join(least, "qid", "left").withColumn("least", F.coalesce("least", none)).withColumn("group", (F.col("home") / group_blocks).cast("int"))
    bounded = materialise(bounded, "vector-bounds")
    parts = cut(bounded, "group", group_blocks * block_rows)
    groups = -(-n_blocks // group_blocks)
    asked = bounded.join(small(parts, 16), "group").withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int")).drop("parts")
    asked = asked.withColumn("beside", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    tiles = parts.select("group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    held = v.withColumn("beside", (F.col("block") / group_blocks).cast("int")).crossJoin(small(tiles, 16))
    return compared(asked, held, ["group", "part", "beside"]).withColumn("rank", r).where(F.col("rank") <= k)


def centroids(vectors: DataFrame) -> DataFrame:
    """(grp, vec): each group's mean vector of length one; sums per dimension, so no group is gathered."""
    parts = vectors.select("grp", F.posexplode("vec").alias("d", "x")).groupBy("grp", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("grp")))
    unit = parts.withColumn("x", F.col("x") / norm)
    return unit.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("vec"))


def vote(neighbours: DataFrame, strong: int = 3) -> DataFrame:
    """(qid, category, confidence, strong): the neighbours' most frequent group, ties to the one met first."""
    counts = neighbours.groupBy("qid", "grp").agg(F.count(F.lit(1)).alias("votes"), F.min("rank").alias("first"))
    w = Window.partitionBy("qid")
    ranked = counts.withColumn("of", F.sum("votes").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("votes"), "first")))
    return ranked.where("r = 1").select("qid", F.col("grp").alias("category"), F.round(F.col("votes") / F.col("of"), 6).alias("confidence"), (F.col("votes") >= strong).alias("strong"))
