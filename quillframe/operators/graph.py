"""Graphs (GRF): link graphs, components, communities.

Components are joined in tasks of bounded size, level by level, and beyond that in rounds that move minima along edges; every level and
round is written to the shared checkpoint folder."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.scratch import materialise

#: A node with more than this share of all edges is a hub; there are fewer than 2 * HUBS of them, which bounds a broadcast.
HUBS, ROUNDS = 256, 100
#: Edges a task joins at a time: some tens of MB.
FOREST_EDGES = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root): the smallest node that each can reach over these edges, roots left out."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(names))
    while True:
        least, new = np.minimum(root[x], root[y]), root.copy()
        np.minimum.at(new, root[x], least)
        np.minimum.at(new, root[y], least)
        while (new[new] < new).any():
            new = new[new]
        if (new == root).all():
            own = np.flatnonzero(root < np.arange(len(root)))
            return names[own], names[root[own]]
        root = new


def forests(edges: DataFrame, most: int) -> DataFrame:
    """Edges (u, v), u > v, with the same components: each task hands on forests of what it reads, ``most`` edges at a time."""

    def joined(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held)
        return pd.DataFrame(dict(zip("uv", forest(rows["u"].to_numpy(), rows["v"].to_numpy()), strict=True)))

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) > most:
                held = [joined(held)]
                if len(held[0]) > most // 2:
                    yield held.pop()
        if held:
            yield joined(held)

    return edges.mapInPandas(join, edges.schema)


def _beside(edges: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """``edges`` (u, v) with the minimum m of u.  Hubs, few by definition, get theirs by a broadcast; so no task holds more
    than a small share of all edges for a hub's sake."""
    hubs = least.where(F.col("n") > max(1_000, n_edges // HUBS)).select("u", F.col("m").alias("hub_m"))
    told = edges.join(F.broadcast(hubs), "u", "left")
    rest = told.where("hub_m is null").select("u", "v").join(least.select("u", "m"), "u")
    return rest.unionByName(told.where("hub_m is not null").select("u", "v", F.col("hub_m").alias("m")))


def linked_components(links: DataFrame, name: str = "graph", most: int | None = None) -> DataFrame:
    """(id, root): the smallest id reachable, for every id of ``links`` (a, b) but those linked with themselves only.

    Tasks of at most ``most`` edges (FOREST_EDGES) join what they hold, and their forests meet in fewer tasks, as long as that
    shrinks them; what fits one such task is settled by it.  A graph whose forest is larger goes on in rounds."""
    most = most or FOREST_EDGES
    edges = materialise(forests(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), most), f"{name}-edges")
    n = edges.count()
    while n > most:
        before, edges = n, materialise(forests(edges.repartition(-(-n // most)), most), f"{name}-edges")
        n = edges.count()
        if n > 0.8 * before:
            break
    edges = materialise(forests(edges.coalesce(1), most), f"{name}-edges") if n <= most else _settled(edges, name)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _settled(edges: DataFrame, name: str) -> DataFrame:
    """(u, v): each node with the smallest one it can reach.

    Alternates large and small stars: neighbours above a node, then those below, move to its smallest one.  Only
    minima are aggregated, no neighbourhood is gathered; rounds grow with the logarithm of the size, and too many are an error."""
    told = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    for _ in range(ROUNDS):
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _beside(both.where("v > u"), least, 2 * told[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionAll(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _beside(large, least, told[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}-edges")
        before, told = told, edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if told == before:
            return edges
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable over (a, b), for every id of ``nodes``."""
    return nodes.select("id").join(linked_components(edges), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) over directed (src, tgt)."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("tgt").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def missing_backlinks(edges: DataFrame) -> DataFrame:
    """Edges without one in the other direction."""
    return edges.select("src", "tgt").distinct().join(edges.select(F.col("tgt").alias("src"), F.col("src").alias("tgt")), ["src", "tgt"], "left_anti")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without a link in or out."""
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("tgt").alias("id")))
    return nodes.join(ends, "id", "left_anti")


def resolve_links(links: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, link) by full key, else by stem to the least key that has it: resolved (src, tgt) and broken (src, link)."""
    full = known.select(F.col("key").alias("link"), F.col("key").alias("tgt"))
    stems = known.groupBy(F.col("stem").alias("link")).agg(F.min("key").alias("by_stem"))
    found = links.join(full, "link", "left").join(stems, "link", "left").withColumn("tgt", F.coalesce("tgt", "by_stem"))
    return found.where("tgt is not null").select("src", "tgt").distinct(), found.where("tgt is null").select("src", "link").distinct()


def density(edges: DataFrame, n_nodes: int) -> DataFrame:
    pairs = n_nodes * (n_nodes - 1) / 2
    undirected = F.countDistinct(F.least("src", "tgt"), F.greatest("src", "tgt"))
    return edges.agg(F.count(F.lit(1)).alias("directed"), undirected.alias("undirected"), F.round(undirected / F.lit(max(pairs, 1.0)), 6).alias("density"))


def move_nodes(start: np.ndarray, to: np.ndarray, w: np.ndarray, m: float, passes: int = 50) -> np.ndarray:
    """Modularity moves until a pass changes nothing: nodes in sorted order go to the neighbouring community of the largest
    positive gain (k_to - k_from) / m + k (S_from - k - S_to) / (2m)^2, ties to the smaller community.

    Node i's neighbours are to[start[i] : start[i + 1]], in order; gives each node's community, named by a member."""
    n = len(start) - 1
    weight = np.array([w[start[i] : start[i + 1]].sum() for i in range(n)])
    home, total = np.arange(n), weight.copy()
    for _ in range(passes):
        moved = False
        for i in range(n):
            at = slice(start[i], start[i + 1])
            near, of = np.unique(home[to[at]], return_inverse=True)
            k, here = np.bincount(of, w[at]), home[i]
            own = k[near == here].sum()
            gains = (k - own) / m + weight[i] * (total[here] - weight[i] - total[near]) / (2 * m) ** 2
            gains[near == here] = -np.inf
            best, gain = here, 0.0
            while (better := gains > gain + 1e-12).any():
                x = int(better.argmax())
                best, gain, gains[: x + 1] = near[x], gains[x], -np.inf
            if best != here:
                total[here] -= weight[i]
                total[best] += weight[i]
                home[i] = best
                moved = True
        if not moved:
            break
    return home


def _settle(frames: Iterator[pd.DataFrame], m: float) -> Iterator[pd.DataFrame]:
    """(id, community) over (u, v, w) with both directions of each edge, in order of u and v.

    Neighbours lie in files while nodes move, so memory grows with nodes, not with edges."""
    names, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    with tempfile.TemporaryFile() as ends, tempfile.TemporaryFile() as weights, tempfile.TemporaryFile() as places:
        for frame in frames:
            u, n = np.unique(frame["u"].to_numpy(np.int64), return_counts=True)
            if len(u) and len(names[-1]) and names[-1][-1] == u[0]:
                counts[-1][-1] += n[0]
                u, n = u[1:], n[1:]
            if len(u):
                names.append(u)
                counts.append(n)
            ends.write(frame["v"].to_numpy(np.int64).tobytes())
            weights.write(frame["w"].to_numpy(float).tobytes())
        ids = np.concatenate(names)
        if not len(ids):
            return
        start = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        ends.seek(0)
        while some := ends.read(8 << 20):
            places.write(np.searchsorted(ids, np.frombuffer(some, np.int64)).tobytes())
        for file in (weights, places):
            file.flush()
        home = move_nodes(start, np.memmap(places, np.int64, "r"), np.memmap(weights, float, "r"), m)
    least = np.full(len(ids), len(ids))
    np.minimum.at(least, home, np.arange(len(ids)))
    yield pd.DataFrame({"id": ids, "community": ids[least[home]]})


def communities(edges: DataFrame, nodes: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(id, community), named by its smallest member, over (a, b, w) with w > threshold; isolated nodes are alone.

    A move only ever goes to a neighbour's community, so connected components are dealt over tasks; only the total weight is global.  Nodes
    move one after the other, so a component is one task's, which keeps its nodes in memory and its edges in files."""
    kept = materialise(edges.where(F.col("w") > threshold), "graph-kept")
    m = kept.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0] or 1.0
    told = kept.join(components(kept, nodes).select(F.col("id").alias("a"), "root"), "a")
    both = told.select("root", F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e"), "w")
    rows = both.select("root", "e.u", "e.v", "w").repartition("root").select("u", "v", "w").sortWithinPartitions("u", "v")
    settled = rows.mapInPandas(lambda frames: _settle(frames, m), "id long, community long")
    return nodes.select("id").join(settled, "id", "left").select("id", F.coalesce("community", "id").alias("community"))
