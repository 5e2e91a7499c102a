"""Exact search for the largest inner products with two cover trees.

Rows are dealt to cells around pivots, and large cells are split, so that each unit of work holds a bounded number of
rows. In a unit, the rows form a cover tree: a node's children are centres further apart than the level's radius, and
every row below is within that radius of its centre. Queries form a second tree. A pair of nodes with centres q and p
and covering radii s and r holds no inner product above <q, p> + s |p| + r |q| + s r, so it is passed over when that
is below the worst k-th score of the queries under its query node.

First each query meets its own cell, which gives it a k-th score to beat; then groups of queries are held against all
cells by the same bound, and meet those that remain. The pivots are a bounded sample; they bear on speed only.

Components are floor(256 x), and scores are sums of whole numbers, so results are exact. Bounds are widened by a small
share against rounding.

Below the first levels, where hardly any rows are close in many dimensions, the rest of a node is cut into leaves by number,
so the lower part is a tree of balls and keeps no separation; bounds and results do not depend on it.

Cases: vectors that are null, empty, or hold null or non-finite components take no part; the query's own row is no
candidate; ties go to the smaller id; rows with one id are candidates each, and queries each if their vectors differ (`query_row`
tells them apart); rows that are equal in id and components are one query, and as candidates count as often as
they stand in the table, less one for the query itself; fewer than k candidates give all; vectors of different lengths do not
meet; null ids take no part; an empty table gives an empty result; extra columns are ignored. There are to be few
different lengths.
"""

from __future__ import annotations

import heapq

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Pivots, rows of a unit, queries of a group, rows of a leaf.
PIVOTS, UNIT_ROWS, GROUP, LEAF = 64, 8192, 512, 64
#: Queries that one task takes to a unit; a unit that is sent more is copied.
TASK_QUERIES = 8 * GROUP


class Node:
    __slots__ = ("centre", "norm", "radius", "rows", "children", "worst")

    def __init__(self, centre, radius, rows, children):
        self.centre, self.norm, self.radius, self.rows, self.children = centre, float(np.linalg.norm(centre)), radius, rows, children
        self.worst = -np.inf


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> Node:
    """A cover tree over the rows of x; the radius halves from level to level."""

    def build(centre: np.ndarray, rows: np.ndarray, level: float) -> Node:
        distances = np.linalg.norm(x[rows] - centre, axis=1)
        radius = float(distances.max(initial=0.0))
        if len(rows) <= leaf or radius == 0:
            return Node(centre, radius, rows, [])
        level = min(level, radius) / 2
        children, rest = [], rows
        while len(rest) and len(children) < max(8, len(rows) // leaf * 2):
            first = x[rest[0]]
            near = np.linalg.norm(x[rest] - first, axis=1) <= level
            children.append((first, rest[near]))
            rest = rest[~near]
        if len(rest):  # at this radius the rest hardly forms groups, and is cut into leaves
            children += [(x[part].mean(axis=0), part) for part in np.array_split(rest, -(len(rest) // -leaf))]
        if len(children) == 1:
            return build(children[0][0], rows, level)
        return Node(centre, radius, rows, [build(c, r, level) for c, r in children])

    return build(x.mean(axis=0), np.arange(len(x)), np.inf)


class Best:
    """The k best of each query: scores descending, ties to smaller ids."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.scores, self.ids = k, [np.empty(0)] * queries, [np.empty(0, np.int64)] * queries
        self.floor = floor.copy()  # a candidate below it is of no use

    def add(self, at: int, scores: np.ndarray, ids: np.ndarray) -> None:
        use = scores >= self.floor[at]
        if not use.any():
            return
        s, i = np.concatenate([self.scores[at], scores[use]]), np.concatenate([self.ids[at], ids[use]])
        order = np.lexsort((i, -s))[: self.k]
        self.scores[at], self.ids[at] = s[order], i[order]
        if len(order) == self.k:
            self.floor[at] = max(self.floor[at], s[order[-1]])


def dual_search(tree: Node, x: np.ndarray, ids: np.ndarray, queries: Node, q: np.ndarray, query_ids: np.ndarray, best: Best, copies: np.ndarray | None = None) -> int:
    """Fill best from all pairs of nodes that can hold a better candidate; the number of leaf pairs that were scored.

    copies: how often each row of x counts; a query's own row, equal in id and components, counts once less.
    """
    copies = np.ones(len(x), dtype=np.int64) if copies is None else copies

    def bound(a: Node, b: Node) -> float:
        return (float(a.centre @ b.centre) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius) * (1 + 1e-9) + 1e-6 * (1 + a.norm * b.norm)

    scored, turn = 0, 0
    heap = [(-bound(queries, tree), 0, queries, tree)]
    while heap:
        high, _, a, b = heapq.heappop(heap)
        if -high < best.floor[a.rows].min():
            continue
        if not a.children and not b.children:
            scored += 1
            products = q[a.rows] @ x[b.rows].T
            for i, row in zip(a.rows.tolist(), products, strict=True):
                same = ids[b.rows] == query_ids[i]
                times = np.minimum(copies[b.rows], best.k + 1)
                if same.any():
                    times = times - (same & (x[b.rows] == q[i]).all(axis=1))
                times = np.minimum(times, best.k)
                best.add(i, np.repeat(row, times), np.repeat(ids[b.rows], times))
            continue
        split_a = a.children and (not b.children or a.radius > b.radius)
        for child in a.children if split_a else b.children:
            pair = (child, b) if split_a else (a, child)
            if (limit := bound(*pair)) >= best.floor[pair[0].rows].min():
                turn += 1
                heapq.heappush(heap, (-limit, turn, *pair))
    return scored


def _cells(df: DataFrame, vec_id: str, vector: str, every: int) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, v, dims, cell, distance, is_query) with vectors as 64-bit numbers, and the pivots by number of dimensions."""
    x = F.col(vector)
    good = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.col(vec_id).isNotNull()
    rows = df.where(good).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * 256).cast("double") + 0.0).alias("v"))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()
    pivots: dict[int, np.ndarray] = {}
    for r in sample:
        pivots.setdefault(len(r.v), []).append(r.v)
    pivots = {d: np.array(p) for d, p in pivots.items()}
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    def make():
        known = shared.value

        def work(rows):
            out = {"vec_id": rows["vec_id"], "v": [], "dims": [], "cell": [], "distance": [], "query_row": []}
            for v in rows["v"]:
                v = np.array(v)
                p = known.get(len(v), np.zeros((1, len(v))))
                d = np.linalg.norm(p - v, axis=1)
                at = int(d.argmin())
                packed = v.astype("<f8").tobytes()
                out["v"].append(packed)
                out["query_row"].append(xxhash.xxh3_64_intdigest(packed) >> 1)
                out["dims"].append(len(v))
                out["cell"].append(at)
                out["distance"].append(float(d[at]))
            return out

        return work

    placed = common.map_rows(rows, make, "vec_id long, v binary, dims int, cell int, distance double, query_row long")
    # equal rows become one, summed up before they are dealt, so no unit is filled with copies
    once = placed.groupBy("vec_id", "query_row", "v").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("dims", "cell", "distance")])
    return once.withColumn("is_query", F.col("vec_id") % every == 0), pivots


def _searched(data: DataFrame, queries: DataFrame, k: int, copies: dict[str, int]) -> DataFrame:
    """query_id, query_row, vec_id, score: the k best of each query in each unit that it is sent to.

    copies: of units that are sent many queries, by the unit's cell; each copy takes a share of the queries.
    """
    spark = data.sparkSession
    many = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in copies.items() for x in pair]), F.substring_index("unit", ":", 2)), F.lit(1)) if copies else F.lit(1)
    copied = lambda which: F.concat_ws(":", "unit", which)
    data = data.select("unit", "vec_id", "v", "copies", F.explode(F.sequence(F.lit(0), many - 1)).alias("copy"))
    both = data.select(copied("copy").alias("unit"), F.lit(0).alias("kind"), "vec_id", F.col("copies").alias("number"), "v", F.lit(None).cast("double").alias("floor")).unionByName(
        queries.select(copied(F.pmod(F.xxhash64("vec_id", "query_row", F.lit(6)), many)).alias("unit"), F.lit(1).alias("kind"), "vec_id", F.col("query_row").alias("number"), "v", "floor")
    )
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = both.repartition(parts, "unit").sortWithinPartitions("unit", "kind", "vec_id", "number")

    def make():
        state = {"unit": None, "data": [], "queries": [], "tree": None}

        def flush(out):
            if state["queries"] and state["data"]:
                if state["tree"] is None:
                    state["x"] = np.frombuffer(b"".join(v for _, v, _ in state["data"]), "<f8").reshape(len(state["data"]), -1)
                    state["ids"] = np.array([i for i, _, _ in state["data"]])
                    state["copies"] = np.array([n for _, _, n in state["data"]])
                    state["tree"] = cover_tree(state["x"])
                q = np.frombuffer(b"".join(v for _, v, _, _ in state["queries"]), "<f8").reshape(len(state["queries"]), -1)
                query_ids = np.array([i for i, _, _, _ in state["queries"]])
                best = Best(len(q), k, np.array([-np.inf if f is None else f for *_, f in state["queries"]]))
                dual_search(state["tree"], state["x"], state["ids"], cover_tree(q, 16), q, query_ids, best, state["copies"])
                for (i, _, n, _), s, v in zip(state["queries"], best.scores, best.ids, strict=True):
                    out["query_id"] += [i] * len(s)
                    out["query_row"] += [n] * len(s)
                    out["vec_id"] += v.tolist()
                    out["score"] += [int(x) for x in s]
            state["queries"] = []

        def work(rows):
            out = {"query_id": [], "query_row": [], "vec_id": [], "score": []}
            if rows is None:
                flush(out)
                return out
            for unit, kind, i, n, v, floor in zip(rows["unit"], rows["kind"], rows["vec_id"], rows["number"], rows["v"], rows["floor"], strict=True):
                if unit != state["unit"]:
                    flush(out)
                    state.update(unit=unit, data=[], queries=[], tree=None)
                if kind == 0:
                    state["data"].append((i, v, n))
                else:
                    state["queries"].append((i, v, n, floor))
                    if len(state["queries"]) == GROUP:
                        flush(out)
            return out

        return work

    return common.map_rows(ordered, make, "query_id long, query_row long, vec_id long, score long", finish=True)


def top_inner_products(df: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, query_row, rank, vec_id, score for each row whose id is divisible by `every`, over all other rows."""
    rows, pivots = _cells(df, vec_id, vector, every)
    rows = common.checkpointed(rows)
    # no more than PIVOTS cells for each number of dimensions among the pivots
    # and one for each other number of dimensions
    cells = {(r.dims, r.cell): (r.n, r.far) for r in rows.groupBy("dims", "cell").agg(F.count("*").alias("n"), F.max("distance").alias("far")).collect()}
    splits = {key: max(1, -(n // -UNIT_ROWS)) for key, (n, _) in cells.items()}
    name = lambda part: F.concat_ws(":", F.col("dims"), F.col("cell"), part)
    split = F.coalesce(_lookup(splits), F.lit(1))
    part = F.pmod(F.xxhash64("vec_id", "query_row", F.lit(5)), split).cast("string")
    data = rows.withColumn("unit", name(part))
    asked = rows.where("is_query")
    own = asked.withColumn("unit", name(F.lit("0"))).withColumn("floor", F.lit(None).cast("double"))
    # the number of queries in a cell tells how often the cell's first unit is copied
    asked_of = {f"{r.dims}:{r.cell}": r.n for r in asked.groupBy("dims", "cell").agg(F.count("*").alias("n")).collect()}
    copies = {c: -(n // -TASK_QUERIES) for c, n in asked_of.items() if n > TASK_QUERIES}
    first = _searched(data.where(part == "0"), own, k, copies)
    floors = first.groupBy(F.col("query_id").alias("vec_id"), "query_row").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("floor"))
    asked = common.checkpointed(asked.join(floors, ["vec_id", "query_row"], "left"))
    shared = df.sparkSession.sparkContext.broadcast((pivots, cells, splits))

    def make():
        pivots, cells, splits = shared.value

        def work(rows):
            out = {n: [] for n in ("vec_id", "query_row", "v", "floor", "unit")}
            groups: dict[tuple[int, int], list[int]] = {}
            for at, key in enumerate(zip(rows["dims"], rows["cell"], strict=True)):
                groups.setdefault(key, []).append(at)
            for (dims, cell), group in groups.items():
                if dims not in pivots:
                    targets = [f"{dims}:{cell}:{s}" for s in range(splits[dims, cell])]
                else:
                    centre, radius = pivots[dims][cell], max(rows["distance"][at] for at in group)
                    worst = min(-np.inf if rows["floor"][at] is None else rows["floor"][at] for at in group)
                    targets = []
                    for (d, c), (_, far) in cells.items():
                        if d == dims:
                            p = pivots[d][c]
                            high = float(centre @ p) + radius * np.linalg.norm(p) + far * np.linalg.norm(centre) + radius * far
                            if high * (1 + 1e-9) + 1 >= worst:
                                targets += [f"{d}:{c}:{s}" for s in range(splits[d, c])]
                for at in group:
                    out["vec_id"] += [rows["vec_id"][at]] * len(targets)
                    out["query_row"] += [rows["query_row"][at]] * len(targets)
                    out["v"] += [rows["v"][at]] * len(targets)
                    out["floor"] += [rows["floor"][at]] * len(targets)
                    out["unit"] += targets
            return out

        return work

    sent = common.map_rows(asked, make, "vec_id long, query_row long, v binary, floor double, unit string")
    # any cell may be asked by all queries of its number of dimensions
    by_dims: dict[str, int] = {}
    for c, n in asked_of.items():
        by_dims[c.split(":")[0]] = by_dims.get(c.split(":")[0], 0) + n
    copies = {f"{d}:{c}": -(by_dims.get(str(d), 0) // -TASK_QUERIES) for d, c in cells if by_dims.get(str(d), 0) > TASK_QUERIES}
    found = _searched(data, sent, k, copies)
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "query_row", "rank", "vec_id", "score")


def _lookup(splits: dict[tuple[int, int], int]):
    """The number of units of a row's cell, from a map with an entry for each cell: PIVOTS at most, and one for each number of dimensions."""
    entries = [x for (d, c), n in splits.items() for x in (F.lit(f"{d}:{c}"), F.lit(n))]
    return F.element_at(F.create_map(*entries), F.concat_ws(":", "dims", "cell")) if entries else F.lit(1)


def op6_dual_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(common.table(spark, sf_dir, "embeddings")).drop("query_row")
