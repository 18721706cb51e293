"""Hard negatives for contrastive training, by a kNN join over Voronoi cells.

Components become floor(scale * x).  With M the greatest length of all vectors, a candidate s is extended by sqrt(M^2 - |s|^2) and an anchor a
by 0; then the squared distance is |a|^2 + M^2 - 2 a.s, so the greatest inner product is the nearest neighbour.  Pivots are spread
over a bounded sample; each candidate belongs to the cell of its nearest pivot and keeps its distance r to it.

Anchors are put into groups of neighbouring cells.  How far an anchor has to look follows from the cells' smallest r a label (for its positives) or
from its positives' scores (for negatives: a ring between two distances).  Triangle inequality and the bisectors between pivots turn that
into the range of r, a cell, that may serve a group; a candidate is sent to those groups only and compared there exactly.  A group's
candidates come in blocks of bounded size, so that no cell, label or set of equal vectors fills a task; each block hands on the best few
of each anchor.  On data without clusters the bounds rule out little and the join is anchors x rows in matrix products.

Scores are exact whole numbers.  Null ids, labels or vectors, null or non-finite components: no part; neither have vectors whose squared length
passes 2**62 (scores would not fit).  Shorter vectors are read as if filled with zeros.  Rows that repeat an id are one row, that with the least label and
vector.  Anchors without positives, and positives without negatives in their window, give no row.  Empty tables give none; other
columns are not looked at."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.common import materialise, small_side
from quillframe.llm.embedding_dedup import finite, spread

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
PIVOTS, SAMPLE, GROUP_ROWS, BLOCK_ROWS = 64, 16, 4_096, 4_096

#: Scores at a time, and the squared length below which doubles hold every partial sum.
CELLS, EXACT = 1 << 20, 1 << 53


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class _Space:
    """The pivots in the extended space, and distances to them."""

    def __init__(self, sample: pd.DataFrame, width: int, top: float, pivots: int):
        self.width, self.top = width, top
        rows = self._extended(sample)
        self.pivots = rows[spread(rows, pivots)] if len(rows) else np.zeros((1, width + 1))
        self.apart = np.sqrt(np.maximum(0, ((self.pivots[:, None] - self.pivots[None]) ** 2).sum(axis=2)))
        #: More than rounding can move a distance by.
        self.slack = 1e-6 * (np.sqrt(top) + 1)

    def _extended(self, rows: pd.DataFrame) -> np.ndarray:
        own = _matrix(rows["v"], self.width)
        return np.hstack([own, np.sqrt(np.maximum(0, self.top - (own * own).sum(axis=1)))[:, None]])

    def candidates(self, rows: pd.DataFrame) -> np.ndarray:
        return np.sqrt(np.maximum(0, self.top + (self.pivots**2).sum(axis=1)[None] - 2 * self._extended(rows) @ self.pivots.T))

    def anchors(self, rows: pd.DataFrame) -> np.ndarray:
        own = _matrix(rows["v"], self.width)
        return np.sqrt(np.maximum(0, (own * own).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1)[None] - 2 * own @ self.pivots[:, :-1].T))

    def ranges(self, d: np.ndarray, cell: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For anchors by pivots: the candidates' r at which a candidate of the cell may be between ``least`` and ``most`` away."""
        low = np.maximum(d - most[:, None], least[:, None] - d) - self.slack
        high = d + most[:, None] + self.slack
        apart = self.apart[cell]
        with np.errstate(divide="ignore", invalid="ignore"):
            beyond = np.where(apart > 0, (d * d - np.take_along_axis(d, cell[:, None], 1) ** 2) / (2 * apart), 0)
        out = (beyond > most[:, None] + self.slack) | (least > most)[:, None]
        return np.where(out, np.inf, low), np.where(out, -np.inf, high)

    def chain(self) -> list[int]:
        """Pivots in an order in which neighbours are near each other."""
        left, order = set(range(1, len(self.pivots))), [0]
        while left:
            order.append(min(left, key=lambda j: (self.apart[order[-1], j], j)))
            left.remove(order[-1])
        return order


def best(score: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``k`` greatest allowed scores, greatest first; equal ones by column."""
    held = np.where(ok, score, np.iinfo(np.int64).min if score.dtype.kind == "i" else -np.inf)
    if held.shape[1] > k:
        ok = ok & (held >= np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k][:, None])
    i, j = np.nonzero(ok)
    order = np.lexsort((j, -held[i, j], i))
    i, j = i[order], j[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], j[first]


def quantised(rows: DataFrame, scale: int) -> DataFrame:
    """(id, label, v): rows that take part, one an id, components as whole numbers."""
    able = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vec")))
    whole = able.select("id", "label", F.transform("vec", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))
    fits = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) <= float(1 << 62)
    return whole.where(fits).groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.label", "row.v")


def _dealt(anchors: DataFrame, cells: DataFrame, ranges: DataFrame, per: DataFrame, keys: list[str], block_rows: int, local: Callable, schema: str) -> DataFrame:
    """``local`` applied to each group's anchors and each block of the candidates that may serve it."""
    on = ["cell", *(k for k in keys if k != "grp")]
    sizes = ranges.join(per, on).groupBy(*keys).agg(F.sum("n").alias("of"))
    sizes = materialise(sizes.select(*keys, F.ceil(F.col("of") / block_rows).cast("int").alias("blocks")), "negatives-blocks")
    n_sizes = sizes.count()
    routes = materialise(ranges.join(small_side(sizes, n_sizes, 48), keys), "negatives-routes")
    served = cells.join(small_side(routes, routes.count(), 64), on).where(F.col("r").between(F.col("low"), F.col("high")))
    served = served.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select(*dict.fromkeys([*keys, "block", "id", "label", "v"]))
    asked = anchors.join(small_side(sizes, n_sizes, 48), keys).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return asked.groupBy(*keys, "block").cogroup(served.groupBy(*keys, "block")).applyInPandas(local, schema)


def _ranges(anchors: DataFrame, space: _Space, keys: list[str], bounds: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(keys, cell, low, high): the r of a cell's candidates that may serve a group; each task hands on its extremes."""

    def span(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            low, high = space.ranges(np.array(frame["d"].tolist()), frame["cell"].to_numpy(), *bounds(frame))
            for key, at in frame.groupby(keys, sort=False).indices.items():
                lo, hi = low[at].min(axis=0), high[at].max(axis=0)
                some = np.flatnonzero(lo <= hi)
                told = dict(zip(keys, key if isinstance(key, tuple) else (key,), strict=True))
                yield pd.DataFrame({**{k: [v] * len(some) for k, v in told.items()}, "cell": some.astype(np.int32), "low": lo[some], "high": hi[some]})

    kinds = ", ".join(f"{k} {anchors.schema[k].dataType.simpleString()}" for k in keys)
    found = anchors.mapInPandas(span, f"{kinds}, cell int, low double, high double")
    return materialise(found.groupBy(*keys, "cell").agg(F.min("low").alias("low"), F.max("high").alias("high")), "negatives-ranges")


def _scores(left: pd.DataFrame, right: pd.DataFrame, space: _Space) -> Iterator[tuple[slice, np.ndarray]]:
    kind = np.float64 if space.top < EXACT else np.int64
    a, b = _matrix(left["v"], space.width).astype(kind), _matrix(right["v"], space.width).astype(kind)
    step = max(1, CELLS // max(1, len(b)))
    for at in range(0, len(a), step):
        yield slice(at, at + step), a[at : at + step] @ b.T


def hard_negatives(
    rows: DataFrame, anchors: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE, positives: int = POSITIVES,
    negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, pivots: int = PIVOTS, group_rows: int = GROUP_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows where ``anchors``, a condition on ``id``, holds.

    A negative n of a positive p has another label and low * score(p) <= 100 * score(n) <= high * score(p)."""
    base = materialise(quantised(rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec")), scale), "negatives-rows")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    top, width = base.agg(F.coalesce(F.max(square), F.lit(0.0)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    space = _Space(base.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(pivots * SAMPLE).toPandas(), max(1, width), top, pivots)
    label = base.schema["label"].dataType.simpleString()

    def to_cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            d = space.candidates(frame)
            cell = d.argmin(axis=1)
            yield frame.assign(cell=cell.astype(np.int32), r=d[np.arange(len(d)), cell])

    def to_distances(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            d = space.anchors(frame)
            yield frame.assign(cell=d.argmin(axis=1).astype(np.int32), d=list(d))

    cells = materialise(base.mapInPandas(to_cells, f"id long, label {label}, v array<double>, cell int, r double"), "negatives-cells")
    asked = base.where(anchors).mapInPandas(to_distances, f"id long, label {label}, v array<double>, cell int, d array<double>")

    # The smallest r of each cell and label bound how far an anchor's positives are.
    nearest = F.row_number().over(Window.partitionBy("label", "cell").orderBy("r"))
    known = cells.select("label", "cell", "r").withColumn("nth", nearest).where(F.col("nth") <= positives + 1)
    known = materialise(known.groupBy("label").agg(F.collect_list("cell").alias("cells"), F.collect_list("r").alias("rs")), "negatives-known")
    asked = materialise(asked.join(small_side(known, known.count(), 16 * pivots * (positives + 1)), "label"), "negatives-anchors")

    def reach(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        most = np.full(len(frame), np.inf)
        for i, (d, at, r) in enumerate(zip(frame["d"], frame["cells"], frame["rs"], strict=True)):
            if len(at) > positives:
                most[i] = np.partition(d[at] + r, positives)[positives]
        return np.zeros(len(frame)), most

    counts = {row["cell"]: row["n"] for row in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a pivot
    start, pieces, group, filled = [0] * len(space.pivots), [1] * len(space.pivots), 0, 0
    for j in space.chain():
        n = counts.get(j, 0)
        if filled and filled + n > group_rows:
            group, filled = group + 1, 0
        start[j], pieces[j] = group, max(1, -(-n // group_rows))
        group, filled = (group, filled + n) if pieces[j] == 1 else (group + pieces[j], 0)
    at = F.col("cell") + 1
    piece = F.pmod(F.xxhash64("id"), F.element_at(F.array(*map(F.lit, pieces)), at)).cast("int")
    asked = asked.withColumn("grp", F.element_at(F.array(*map(F.lit, start)), at) + piece)

    def to_positives(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("id")
        ids, other, out = left["id"].to_numpy(), right["id"].to_numpy(), []
        for part, score in _scores(left, right, space):
            i, j = best(score, ids[part][:, None] != other[None], positives)
            out.append(pd.DataFrame({"id": ids[part][i], "positive": other[j], "score": score[i, j].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "positive": [], "score": []})

    per = materialise(cells.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("n")), "negatives-counts")
    keys = ["label", "grp"]
    found = _dealt(asked.select("id", "label", "v", "grp"), cells, _ranges(asked, space, keys, reach), per, keys, block_rows, to_positives, "id long, positive long, score long")
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "positive"))
    found = found.withColumn("nth", nth).where(F.col("nth") <= positives).where("score >= 0")
    found = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("nth", "positive", "score"))).alias("of"))
    found = found.select("id", F.col("of.positive").alias("ids"), F.col("of.score").alias("scores"))
    ringed = materialise(asked.select("id", "label", "v", "grp", "cell", "d").join(found, "id"), "negatives-positives")

    def ring(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        own = (_matrix(frame["v"], space.width) ** 2).sum(axis=1)
        far = np.array([min(s) * (low / 100) for s in frame["scores"]])
        near = np.array([max(s) * (high / 100) for s in frame["scores"]])
        return np.sqrt(np.maximum(0, own + space.top - 2 * near)), np.sqrt(np.maximum(0, own + space.top - 2 * far))

    def to_negatives(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("id")
        codes = pd.factorize(pd.concat([left["label"], right["label"]]))[0]
        mine, theirs, out = codes[: len(left)], codes[len(left) :], []
        ids, other = left["id"].to_numpy(), right["id"].to_numpy()
        n = max(map(len, left["scores"]), default=0)
        scores, names = np.full((len(left), n), -1, np.int64), np.zeros((len(left), n), np.int64)
        for i, (s, p) in enumerate(zip(left["scores"], left["ids"], strict=True)):
            scores[i, : len(s)], names[i, : len(s)] = s, p
        for part, score in _scores(left, right, space):
            unlike = mine[part][:, None] != theirs[None]
            for k in range(n):
                p = scores[part, k]
                # 100 n >= low p and 100 n <= high p, in whole numbers that can't overflow.
                least, most = -(-low * p // 100) if low * int(p.max()) < EXACT else _divided(p, low, up=True), high * p // 100 if high * int(p.max()) < EXACT else _divided(p, high)
                i, j = best(score, unlike & (score >= least[:, None]) & (score <= most[:, None]) & (p >= 0)[:, None], negatives)
                out.append(pd.DataFrame({"id": ids[part][i], "positive": names[part][i, k], "p": p[i], "negative": other[j], "score": score[i, j].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "positive": [], "p": [], "negative": [], "score": []})

    per_cell = per.groupBy("cell").agg(F.sum("n").alias("n"))
    schema = "id long, positive long, p long, negative long, score long"
    mined = _dealt(ringed.select("id", "label", "v", "grp", "ids", "scores"), cells, _ranges(ringed, space, ["grp"], ring), per_cell, ["grp"], block_rows, to_negatives, schema)
    rank = F.row_number().over(Window.partitionBy("id", "positive").orderBy(F.desc("score"), "negative")).cast("int")
    mined = mined.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return mined.select(
        F.col("id").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"),
        F.col("p").alias("positive_score"), F.col("score").alias("negative_score"),
    )


def _divided(p: np.ndarray, share: int, up: bool = False) -> np.ndarray:
    """share * p / 100 to the next whole number, for values whose product passes 64 bits."""
    return np.array([-(-share * x // 100) if up else share * x // 100 for x in map(int, p)], np.int64)
