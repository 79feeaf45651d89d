"""Operator 1: exact top-k inner-product search with dual cover trees."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctuo.llm.common import cut


#: No score, which is an integer of 64 bits: less than any.
NO_SCORE = -(2**63 - 1)
#: Relative error that sums of products of doubles stay well within.
SLACK = 1e-12


@dataclass
class Node:
    start: int
    end: int
    center: np.ndarray
    radius: float
    norm: float
    children: list[int]


class CoverTree:
    """Points in tree order with nodes over ranges of them; every node's centre is one of its points.

    A node's points lie within its covering radius, measured, of its centre.  Children cover theirs within half that
    radius and their centres are further apart than it, the first child keeping the centre.  Where more than ``fan``
    children would be needed, the rest goes to the nearest of them.
    """

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = 128, fan: int = 16):
        self.nodes: list[Node] = []
        x = points.astype(np.float64)
        order = np.arange(len(x))
        todo = [(0, len(x), None)]
        while todo:
            start, end, parent = todo.pop()
            rows = order[start:end].copy()  # the order changes below
            far = np.sqrt(np.maximum(((x[rows] - x[rows[0]]) ** 2).sum(axis=1), 0))
            center = x[rows[0]]
            node = Node(start, end, center, float(far.max()), float(np.sqrt(center @ center)), [])
            if parent is not None:
                self.nodes[parent].children.append(len(self.nodes))
            self.nodes.append(node)
            if end - start <= leaf or node.radius == 0:
                continue
            group, near, made = np.full(len(rows), -1), node.radius / 2, 0
            group[far <= near] = 0
            nearest = far
            centers = [0]
            while (group < 0).any() and len(centers) < fan:
                made = int(np.flatnonzero(group < 0)[0])
                d = np.sqrt(((x[rows] - x[rows[made]]) ** 2).sum(axis=1))
                group[(group < 0) & (d <= near)] = len(centers)
                nearest = np.vstack([nearest, d])
                centers.append(made)
            if (group < 0).any():
                rest = group < 0
                group[rest] = nearest[:, rest].argmin(axis=0)
            if len(centers) == 1:
                continue
            at = start
            for g, c in enumerate(centers):
                own = np.flatnonzero(group == g)
                own = np.concatenate([[c], own[own != c]])
                order[at : at + len(own)] = rows[own]
                todo.append((at, at + len(own), len(self.nodes) - 1))
                at += len(own)
        self.points, self.ids, self.order = points[order], ids[order], order


def bound(center: np.ndarray, radius, norm, other: np.ndarray, other_radius, other_norm):
    """No inner product between the two balls is larger; the last term outweighs what rounding may have lost."""
    slack = 1e-6 + SLACK * (norm + radius) * (other_norm + other_radius)
    return (other @ center) + norm * other_radius + other_norm * radius + radius * other_radius + slack


def dual_search(queries: CoverTree, floor: np.ndarray, data: CoverTree, k: int) -> list[tuple[int, int, int]]:
    """(query, vector, score) for the best ``k`` of ``data`` for each query that reach its ``floor``.

    Pairs of nodes are visited best bound first; a pair is dropped when its bound is under the worst kth score of the
    query node's points.
    """
    exact = float(np.abs(queries.points).max(initial=0)) * float(np.abs(data.points).max(initial=0))
    kind = np.float64 if exact * max(1, data.points.shape[1]) < 2**52 else np.int64
    q, x = queries.points.astype(kind), data.points.astype(kind)
    low = floor[queries.order]
    worst = np.full(len(q), NO_SCORE)
    worst[np.isfinite(low)] = np.floor(np.clip(low[np.isfinite(low)], -(2.0**62), 2.0**62)).astype(np.int64)
    scores = np.full((len(q), k), NO_SCORE)
    best = np.full((len(q), k), np.iinfo(np.int64).max)
    todo = [(0, 0, np.inf)]
    while todo:
        i, j, most = todo.pop()
        a, b = queries.nodes[i], data.nodes[j]
        if most < worst[a.start : a.end].min():
            continue
        if a.children and (not b.children or a.radius >= b.radius):
            pairs = [(c, j) for c in a.children]
        elif b.children:
            pairs = [(i, c) for c in b.children]
        else:
            span, other = slice(a.start, a.end), slice(b.start, b.end)
            s = (q[span] @ x[other].T).astype(np.int64)
            ids = data.ids[other]
            s[queries.ids[span][:, None] == ids[None, :]] = NO_SCORE
            s[s < worst[span][:, None]] = NO_SCORE
            good = s > NO_SCORE
            hit, some = np.flatnonzero(good.any(axis=1)), np.flatnonzero(good.any(axis=0))
            if len(hit):
                at = hit + a.start
                s, ids = s[:, some], ids[some]
                all_s = np.hstack([scores[at], s[hit]])
                all_i = np.hstack([best[at], np.broadcast_to(ids, (len(hit), len(ids)))])
                order = np.lexsort((all_i, -all_s), axis=-1)[:, :k]
                scores[at] = np.take_along_axis(all_s, order, 1)
                best[at] = np.take_along_axis(all_i, order, 1)
                worst[at] = np.maximum(worst[at], scores[at, -1])
            continue
        new = []
        for c, d in pairs:
            m, n = queries.nodes[c], data.nodes[d]
            new.append((c, d, float(bound(m.center, m.radius, m.norm, n.center, n.radius, n.norm))))
        todo += sorted(new, key=lambda t: t[2])
    rows, cols = np.nonzero(scores > NO_SCORE)
    return list(zip(queries.ids[rows].tolist(), best[rows, cols].tolist(), scores[rows, cols].tolist()))


def quantised(embedding: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component; null for vectors that are null or hold a null or non-finite component."""
    bad = F.exists(
        embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    )
    return F.when(~bad, F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def search(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 20,
    k: int = 20,
    block_rows: int = 2048,
    group_rows: int = 256,
    sample_rows: int = 4096,
    cells: int = 16,
) -> DataFrame:
    """Each query's ``k`` best rows by integer inner product: query_id, rank, vec_id, score; ties to the smaller vec_id.

    Queries are the rows whose id is divisible by ``every``.  At most ``sample_rows`` rows, in hash order, serve as
    index sample: ``cells`` of them, far apart, are centres, every row goes to the nearest, and a cell is dealt by id
    hash into blocks of about ``block_rows`` rows, so a common vector fills many blocks.  A block is a cover tree; so is
    a group of about ``group_rows`` queries of a cell.  The sample also gives every query a first kth score.  Pairs of
    group and block meet only if the covering radii allow a score of the group's worst kth; each pair is one dual-tree
    search, and the pairs' results are merged per query.  Nothing is approximate as long as scores fit 64 bits.

    Vectors that are null or hold null or non-finite components take no part, nor do rows with a null id; shorter
    vectors count as filled up with zeros.  Rows with the query's own id are never its results; other repeated ids are
    rows of their own.  An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col)).alias("v"))
    rows = cut(rows.filter("id is not null and v is not null"), "topk-vectors")
    facts = rows.agg(
        F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))), F.count(F.lit(1))
    ).first()
    width = max(1, facts[0] or 0)
    kind = "<i4" if (facts[1] or 0) < 2**31 else "<i8"
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).toArrow().combine_chunks()
    column = sample["v"].combine_chunks() if isinstance(sample["v"], pa.ChunkedArray) else sample["v"]
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
    seeds = _matrix(column, width).astype(np.float64) if len(sample) else np.zeros((0, width))
    seed_ids = sample["id"].to_numpy() if len(sample) else np.zeros(0, np.int64)
    pick, near = [0] if len(seeds) else [], None
    while seeds.size and len(pick) < min(cells, len(seeds)):  # farthest first
        d = ((seeds - seeds[pick[-1]]) ** 2).sum(axis=1)
        near = d if near is None else np.minimum(near, d)
        if near.max() == 0:
            break
        pick.append(int(near.argmax()))
    centers = seeds[pick]
    square = (centers**2).sum(axis=1)
    longest = float(np.sqrt((seeds**2).sum(axis=1).max(initial=0)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                x, ids = _matrix(b.column(1), width), b.column(0).to_numpy()
                cell = (square - 2 * (x @ centers.T)).argmin(axis=1)
                asks, floor = ids % every == 0, np.full(len(ids), -np.inf)
                if asks.any() and len(seeds) > k:
                    s = x[asks] @ seeds.T
                    s[ids[asks][:, None] == seed_ids[None, :]] = -np.inf
                    lost = SLACK * longest * np.sqrt((x[asks].astype(np.float64) ** 2).sum(axis=1))
                    floor[asks] = np.partition(s, len(seeds) - k, axis=1)[:, len(seeds) - k] - lost
                packed = x.astype(kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids), pa.array(cell.astype(np.int32)), pa.array(asks), pa.array(floor),
                        pa.array([r.tobytes() for r in packed], pa.binary()),
                    ],
                    names=["id", "cell", "asks", "floor", "v"],
                )

    dealt = cut(rows.mapInArrow(deal, "id long, cell int, asks boolean, floor double, v binary"), "topk-dealt")
    counts = F.broadcast(  # at most `cells` rows
        dealt.groupBy("cell").agg(
            F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"),
            F.ceil(F.sum(F.col("asks").cast("int")) / group_rows).alias("groups"),
        )
    )
    dealt = dealt.join(counts, "cell")

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        points = np.frombuffer(b"".join(pdf["v"]), kind).reshape(len(pdf), width).astype(np.int64)
        made = CoverTree(points, pdf["id"].to_numpy())
        root, floor = made.nodes[0], pdf["floor"].to_numpy()
        made.points = made.points.astype(kind)
        return pd.DataFrame(
            {
                "part": [int(pdf["part"].iloc[0])], "center": [root.center], "radius": [root.radius],
                "worst": [float(floor.min())], "tree": [pickle.dumps((made, floor))],
            }
        )

    kinds = "part long, center array<double>, radius double, worst double, tree binary"

    def trees(of: DataFrame, parts: str, name: str) -> DataFrame:
        part = F.col("cell").cast("long") * (1 << 32) + F.pmod(F.xxhash64("id", F.lit(3)), F.col(parts))
        return cut(of.withColumn("part", part).groupBy("part").applyInPandas(tree, kinds), name)

    blocks = trees(dealt.select("id", "cell", "floor", "v", "blocks"), "blocks", "topk-blocks")
    groups = trees(dealt.filter("asks").select("id", "cell", "floor", "v", "groups"), "groups", "topk-groups")

    # Balls of blocks in lots of about 1,024; each query group meets every lot, as every query meets all rows.
    lots = max(1, -(-blocks.count() // 1024))
    balls = blocks.select("part", "center", "radius", F.pmod(F.xxhash64("part"), F.lit(lots)).alias("lot"))
    balls = balls.groupBy("lot").agg(F.collect_list(F.struct("part", "center", "radius")).alias("balls"))
    asked = groups.select(
        F.col("part").alias("asking"), "center", "radius", "worst", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot")
    )

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asking, part = [], []
            for row in b.to_pylist():
                c = np.array(row["center"])
                others = np.array([o["center"] for o in row["balls"]])
                radii = np.array([o["radius"] for o in row["balls"]])
                norms = np.sqrt((others**2).sum(axis=1))
                most = bound(c, row["radius"], float(np.sqrt(c @ c)), others, radii, norms)
                for o in np.flatnonzero(most >= row["worst"]):
                    asking.append(row["asking"])
                    part.append(row["balls"][o]["part"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(asking, pa.int64()), pa.array(part, pa.int64())], names=["asking", "part"]
            )

    pairs = asked.join(balls, "lot").drop("lot").mapInArrow(allowed, "asking long, part long")
    met = pairs.join(groups.select(F.col("part").alias("asking"), F.col("tree").alias("queries")), "asking").join(
        blocks.select("part", F.col("tree").alias("data")), "part"
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                queries, floor = pickle.loads(batch.column(0)[at].as_py())
                data, _ = pickle.loads(batch.column(1)[at].as_py())
                found = dual_search(queries, floor, data, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"]
                )

    found = met.select("queries", "data").mapInArrow(meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
