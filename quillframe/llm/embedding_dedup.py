"""Near-duplicates of embeddings by a pivot-permutation index.

Equal vectors of one label become one class first.  A class is described by its ``near`` nearest of ``pivots`` reference vectors, in
order.  Inverted lists hold, for each label and pivot, the classes that name the pivot; two classes are compared if they share
``shared`` named pivots or more, and linked if their cosine in double precision reaches the threshold.  Pivots are numbered from the
rarest; as pairs must share several, a class is listed under its near - shared + 1 rarest pivots only, and a pair is compared in the
list of its rarest shared pivot, so once.

Reference vectors are the only thing fitted on a sample: of SAMPLE classes a pivot, in the order of a hash, those that are farthest from the
ones before.  Every class is indexed.  Lists are cut into blocks of at most about BLOCK_ROWS classes and each pair of blocks is a
task of its own, so a label, pivot or group of copies may hold any share of the rows.  A pair of blocks hands on one row a class: its number of links there and
the smallest class it hangs together with there; pairs are never rows.

Recall is measured in the tests against brute force: a pair is missed only if its two descriptions share fewer than ``shared``
pivots.  With as many pivots as ``near`` or fewer (small tables) all pairs are compared.

Null ids, labels or vectors, zero vectors, null or non-finite components: no links, the row is its own component.  Vectors of unlike
lengths don't link.  Rows that repeat an id and vector count as vectors of their own; rows of one id with different vectors too.
Empty tables give no rows; other columns are not looked at."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import materialise, small_side
from quillframe.operators.graph import forest, linked_components

THRESHOLD, PIVOTS, NEAR, SHARED, SAMPLE, BLOCK_ROWS = 0.93, 128, 8, 3, 8, 2_048

#: Elements of a comparison at a time, and the share of candidates from which a whole product is cheaper.
CELLS, DENSE = 1 << 20, 0.05


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def unit(vectors: pd.Series, width: int = 0) -> np.ndarray:
    """Rows of length one, shorter ones filled with zeros to the width."""
    width = max([width, *map(len, vectors)])
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    out /= np.abs(out).max(axis=1, initial=0, keepdims=True)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def spread(rows: np.ndarray, n: int) -> np.ndarray:
    """Positions of up to ``n`` different rows, each the farthest from those before it; ties to the first."""
    chosen, far = [], np.full(len(rows), np.inf)
    while len(chosen) < min(n, len(rows)) and far.max(initial=0) > 1e-12:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen, np.int64)


def classes_of(rows: DataFrame) -> DataFrame:
    """(node, label, vec, rep, n, h1, h2): equal usable vectors of a label of (id, label, vec)."""
    able = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vec")) & F.exists("vec", lambda x: x != 0))
    grouped = able.groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    return materialise(grouped.withColumns({"node": F.monotonically_increasing_id(), **_digest()}), "embedding-classes")


def _digest() -> dict[str, Column]:
    """128 bits that stand for a label and vector."""
    return {"h1": F.xxhash64("label", "vec"), "h2": F.xxhash64(F.lit(1), "vec", "label")}


def described(classes: DataFrame, pivots: int, near: int) -> DataFrame:
    """(node, label, dim, u, n, order): each class's unit vector and its nearest pivots' numbers, nearest first."""
    sample = classes.select("vec", "h1").orderBy("h1", "node").limit(pivots * SAMPLE).toPandas()
    width = classes.agg(F.coalesce(F.max(F.size("vec")), F.lit(1))).first()[0]
    if len(sample):
        base = unit(sample["vec"], width)
        base = base[spread(base, pivots)]

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            u = unit(frame["vec"], width)
            order = np.argsort(-(u @ base.T), axis=1, kind="stable")[:, :near].astype(np.int32)
            frame["u"] = [x[: len(v)] for x, v in zip(u, frame["vec"], strict=True)]
            frame["order"] = list(order)
            frame["dim"] = frame["vec"].map(len)
            yield frame[["node", "label", "dim", "u", "n", "order"]]

    kind = classes.schema["label"].dataType.simpleString()
    return materialise(classes.select("node", "label", "vec", "n").mapInPandas(describe, f"node long, label {kind}, dim int, u array<double>, n long, order array<int>"), "embedding-orders")


def _bits(ranks: pd.Series) -> np.ndarray:
    """One row of 64-bit words a class, with the bits of its pivots set."""
    own = np.array(ranks.tolist(), np.int64)
    words, row = np.zeros((len(own), (int(own.max()) >> 6) + 1), np.uint64), np.arange(len(own))
    for k in range(own.shape[1]):
        words[row, own[:, k] >> 6] |= np.uint64(1) << (own[:, k] & 63).astype(np.uint64)
    return words


def _linked(rows: pd.DataFrame, pivot: int, same: bool, shared: int, threshold: float) -> pd.DataFrame:
    """(node, links, root) of one pair of blocks, ``rows`` with their side."""
    left, right = (rows, rows) if same else (rows[rows["side"] == 0], rows[rows["side"] == 1])
    told = {"node": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)}
    if left.empty or right.empty:
        return pd.DataFrame(told)
    bits = _bits(rows["ranks"])
    a, b = (bits, bits) if same else (bits[(rows["side"] == 0).to_numpy()], bits[(rows["side"] == 1).to_numpy()])
    x, y = np.array(left["u"].tolist()), np.array(right["u"].tolist())
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    sums = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
    n_left, n_right = left["n"].to_numpy(), right["n"].to_numpy()
    nodes = left["node"].to_numpy(), right["node"].to_numpy()
    step = max(1, CELLS // len(right))
    for at in range(0, len(left), step):
        part, common, earlier = slice(at, at + step), 0, False
        for w in range(bits.shape[1]):
            both = a[part, w][:, None] & b[:, w][None]
            common = common + np.bitwise_count(both).astype(np.int16)
            below = min(64, max(0, pivot - 64 * w))
            if below:
                earlier = earlier | ((both & np.uint64((1 << below) - 1)) != 0)
        ok = (common >= shared) & ~earlier if earlier is not False else common >= shared
        if same:
            ok &= np.arange(len(right))[None] > np.arange(at, at + len(ok))[:, None]
        if ok.mean() > DENSE:
            i, j = np.nonzero(ok & (x[part] @ y.T >= threshold))
        else:
            i, j = np.nonzero(ok)
            near = np.einsum("ij,ij->i", x[part][i], y[j]) >= threshold
            i, j = i[near], j[near]
        sums[0][part] += np.bincount(i, weights=n_right[j], minlength=len(ok)).astype(np.int64)
        sums[1][:] += np.bincount(j, weights=n_left[part][i], minlength=len(right)).astype(np.int64)
        if len(i):
            ends.append(forest(nodes[0][part][i], nodes[1][j]))
    if not ends:
        return pd.DataFrame(told)
    node, root = forest(*map(np.concatenate, zip(*ends, strict=True)))
    roots = dict(zip(node.tolist(), root.tolist(), strict=True))
    links = pd.DataFrame({"node": np.concatenate(nodes), "links": np.concatenate(sums)}).groupby("node", as_index=False)["links"].sum()
    links = links[links["links"] > 0]
    return links.assign(root=[roots.get(k, k) for k in links["node"]])


def class_links(orders: DataFrame, shared: int, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node, links, root): a class's links in a pair of blocks, copies counted, and the least class it hangs together with there."""
    counts = orders.select(F.explode("order").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "p").collect()  # one row a pivot
    rank = F.create_map(*[F.lit(x) for i, row in enumerate(counts) for x in (row["p"], i)]) if counts else F.create_map(F.lit(0), F.lit(0))
    ranks = F.array_sort(F.transform("order", lambda p: rank[p]))
    listed = orders.withColumn("ranks", ranks).withColumn("pivot", F.explode(F.slice("ranks", F.lit(1), F.greatest(F.lit(1), F.size("ranks") - shared + 1))))
    lists = materialise(listed.groupBy("label", "dim", "pivot").agg(F.count(F.lit(1)).alias("of")).where("of > 1").withColumn("blocks", F.ceil(F.col("of") / block_rows).cast("int")).drop("of"), "embedding-lists")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = listed.drop("order").join(small_side(lists, lists.count(), 64), ["label", "dim", "pivot"]).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")})

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        return _linked(rows, int(first["pivot"]), first["lo"] == first["hi"], min(shared, len(first["ranks"])), threshold)

    cut = dealt.select("node", "label", "dim", "pivot", "lo", "hi", "side", "u", "n", "ranks")
    return materialise(cut.groupBy("label", "dim", "pivot", "lo", "hi").applyInPandas(compare, "node long, links long, root long"), "embedding-links")


def near_vectors(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD,
    pivots: int = PIVOTS, near: int = NEAR, shared: int = SHARED, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row."""
    base = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    classes = classes_of(base)
    links = class_links(described(classes, pivots, near), shared, threshold, block_rows)
    roots = linked_components(links.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), "embedding")
    told = classes.join(roots.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    told = told.join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").select("label", "h1", "h2", "rep", "root", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    told = materialise(told, "embedding-told")
    least = told.groupBy("root").agg(F.min("rep").alias("component"))
    found = materialise(told.join(least, "root").select("label", "h1", "h2", "n_links", "component"), "embedding-found")
    able = F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vec")) & F.exists("vec", lambda x: x != 0)
    slim = base.withColumns(_digest()).select("id", "label", "h1", "h2", F.coalesce(able, F.lit(False)).alias("able"))
    alone = slim.where("not able").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    joined = slim.where("able").join(small_side(found, found.count(), 64), ["label", "h1", "h2"]).select("id", "n_links", "component")
    return joined.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")
    )
