"""A metric index for vectors: pivots, cells and triangle bounds that rule blocks out exactly.

Inner products become distances: with M the greatest length, an indexed vector s is extended by sqrt(M^2 - |s|^2), a query by 0, and the
squared distance is |q|^2 + M^2 - 2 q.s.  Pivots are spread over a bounded sample of the indexed vectors; each vector belongs to the cell of its nearest
pivot, and a cell is cut into blocks of bounded size.  A block keeps, for each pivot, the least and greatest distance of its vectors:
what is further from a query than its reach, or further from a block than the threshold allows, is never compared.
On clustered vectors most blocks go; on vectors without structure all are compared, as before."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.scratch import materialise

#: Pivots at most, of which there are about two a block; sampled vectors a pivot; vectors of a block.
PIVOTS, SAMPLE, BLOCK_ROWS = 256, 16, 2_000
#: Rows times width up to which a table of blocks is broadcast.
BROADCAST_BYTES = 32 << 20


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of doubles; shorter vectors are filled with zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def spread(rows: np.ndarray, n: int) -> np.ndarray:
    """Positions of up to ``n`` different rows, each the farthest from those before it; ties to the first."""
    chosen, far = [], np.full(len(rows), np.inf)
    while len(chosen) < min(n, len(rows)) and far.max(initial=0) > 1e-12:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen, np.int64)


class Space:
    """Pivots in the extended space, and distances to them."""

    def __init__(self, sample: pd.Series, width: int, top: float, pivots: int = PIVOTS):
        self.width, self.top = width, top
        rows = self.extended(matrix(sample, width))
        self.pivots = rows[spread(rows, pivots)] if len(rows) else np.zeros((1, width + 1))
        #: More than rounding can move a distance by.
        self.slack = 1e-6 * (np.sqrt(top) + 1)

    def extended(self, own: np.ndarray) -> np.ndarray:
        return np.hstack([own, np.sqrt(np.maximum(0, self.top - (own * own).sum(axis=1)))[:, None]])

    def indexed(self, own: np.ndarray) -> np.ndarray:
        """Distances of indexed vectors to the pivots."""
        return np.sqrt(np.maximum(0, self.top + (self.pivots**2).sum(axis=1)[None] - 2 * self.extended(own) @ self.pivots.T))

    def queries(self, own: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (own * own).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1)[None] - 2 * own @ self.pivots[:, :-1].T))


def small(df: DataFrame, width: int) -> DataFrame:
    """With a broadcast hint if its counted rows times ``width`` bytes are few."""
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else df


class Index:
    """An index over (id, vec, grp): ``rows`` with their block, ``blocks`` with their distances to the pivots."""

    def __init__(self, vectors: DataFrame, block_rows: int = BLOCK_ROWS, pivots: int | None = None):
        square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        n, top, width = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(square), F.lit(0.0)), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
        pivots = pivots or min(PIVOTS, 2 * max(1, -(-n // block_rows)) - 1)
        sample = vectors.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(pivots * SAMPLE).toPandas()
        self.n, self.space, self.block_rows = n, Space(sample["vec"], max(1, width), top, pivots), block_rows
        space = self.space

        def to_cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                d = space.indexed(matrix(frame["vec"], space.width))
                yield frame.assign(cell=d.argmin(axis=1).astype(np.int32), d=list(d))

        kinds = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in ("id", "vec", "grp"))
        placed = materialise(vectors.select("id", "vec", "grp").mapInPandas(to_cells, f"{kinds}, cell int, d array<double>"), "metric-cells")
        counts = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a pivot
        many = [max(1, -(-counts.get(j, 0) // block_rows)) for j in range(len(space.pivots))]
        self.counts, self.many = counts, many
        pieces = F.array(*map(F.lit, many))
        piece = F.pmod(F.xxhash64("id"), F.element_at(pieces, F.col("cell") + 1)).cast("long")
        self.rows = placed.withColumn("block", F.col("cell").cast("long") * (1 << 32) + piece)

        def extremes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                d = np.array(frame["d"].tolist())
                for key, at in frame.groupby("block", sort=False).indices.items():
                    yield pd.DataFrame({"block": key, "j": np.arange(d.shape[1], dtype=np.int32), "lo": d[at].min(axis=0), "hi": d[at].max(axis=0)})

        each = self.rows.select("block", "d").mapInPandas(extremes, "block long, j int, lo double, hi double").groupBy("block", "j").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        in_order = F.array_sort(F.collect_list(F.struct("j", "lo", "hi")))  # as many as there are pivots
        self.blocks = materialise(each.groupBy("block").agg(in_order.alias("s")).select("block", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi")), "metric-blocks")

    def number(self, block: Column) -> Column:
        """Blocks counted from 0, cell by cell."""
        first = [sum(self.many[:j]) for j in range(len(self.many))]
        return F.element_at(F.array(*map(F.lit, first)), (block / (1 << 32)).cast("int") + 1) + F.pmod(block, F.lit(1 << 32))

    def block_pairs(self, threshold: float) -> DataFrame:
        """(left, right), left <= right: blocks that may hold vectors with an inner product of at least ``threshold``.

        A pair is ruled out by any pivot whose two rings lie further apart than such vectors can.  Blocks meet cell by cell, and cells, few by
        definition, are compared first."""
        reach = float(np.sqrt(max(0.0, 2 * self.space.top - 2 * threshold)) + self.space.slack)
        cells = self.blocks.select((F.col("block") / (1 << 32)).cast("int").alias("cell"), F.posexplode(F.arrays_zip("lo", "hi")).alias("j", "s"))
        rings = cells.groupBy("cell", "j").agg(F.min("s.lo").alias("lo"), F.max("s.hi").alias("hi")).groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("j", "lo", "hi"))).alias("s")).collect()
        low, high = (np.array([[x[k] for x in r["s"]] for r in rings]) for k in ("lo", "hi"))
        names = [r["cell"] for r in rings]
        near = [(names[i], names[k]) for i in range(len(names)) for k in range(len(names)) if (np.maximum(low[i] - high[k], low[k] - high[i]) <= reach).all()]
        allowed = self.blocks.sparkSession.createDataFrame(near or [(-1, -1)], "lc int, rc int")
        side = lambda s: self.blocks.select(F.col("block").alias(s), (F.col("block") / (1 << 32)).cast("int").alias(f"{s[0]}c"), F.col("lo").alias(f"{s}_lo"), F.col("hi").alias(f"{s}_hi"))
        met = side("left").join(F.broadcast(allowed), "lc").join(side("right"), "rc").where("left <= right")
        gap = lambda a, b: F.exists(F.zip_with(f"{a}_lo", f"{b}_hi", lambda x, y: x - y), lambda g: g > reach)
        return met.where(~gap("left", "right") & ~gap("right", "left")).select("left", "right")

    def visits(self, queries: DataFrame, reach: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
        """(qid, block): blocks that may hold a vector within each query's reach, a distance; queries are (qid, vec, ..)."""
        space, blocks = self.space, self.blocks

        def rings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield pd.DataFrame({"qid": frame["qid"], "q": list(space.queries(matrix(frame["vec"], space.width))), "reach": reach(frame) + space.slack})

        asked = queries.mapInPandas(rings, f"qid {queries.schema['qid'].dataType.simpleString()}, q array<double>, reach double")
        # A block's own cell first, by a plain join; the other pivots then.
        flat = blocks.select("block", "lo", "hi", (F.col("block") / (1 << 32)).cast("int").alias("cell"))
        first = lambda c: F.element_at(c, F.col("cell") + 1)
        spans = flat.groupBy("cell").agg(F.min(first("lo")).alias("c_lo"), F.max(first("hi")).alias("c_hi"))  # one row a pivot
        each = asked.select("qid", "reach", "q", F.posexplode("q").alias("cell", "d")).join(F.broadcast(spans), "cell")
        each = each.where((F.col("d") - F.col("reach") <= F.col("c_hi")) & (F.col("d") + F.col("reach") >= F.col("c_lo"))).select("qid", "reach", "q", "cell")
        met = each.join(small(flat, 20 * (len(space.pivots) + 1)), "cell")
        ruled_out = F.exists(F.zip_with("q", F.arrays_zip("lo", "hi"), lambda d, s: (d - s["hi"] > F.col("reach")) | (s["lo"] - d > F.col("reach"))), lambda x: x)
        return met.where(~ruled_out).select("qid", "block")
