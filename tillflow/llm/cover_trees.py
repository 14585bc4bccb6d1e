"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are dealt to cells around sampled centres, the top of the tree. A cell beyond
one block sets a sample aside as its block 0 and is cut around centres of its own,
its parts again, until they have the size of a block; only copies are dealt by hash.
Data blocks and query groups get a cover tree each, kept as one row. A query group
meets block 0 of its own cell first, and each query then asks the block that its vector
points to. The scores found there decide which cells, and which blocks of these, the
group has to visit. Where group and block meet, both trees are
descended together: a pair of nodes is dropped when no product between their balls
can reach the group's worst k-th score.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillflow.llm.common import bounded_batches, saved, table

#: A child's ball is this much smaller than its parent's.
BASE = 1.3
LEAF = 32
BLOCK_ROWS = 2048
MOST_CENTRES = 1024
#: About so many parts at most that a cell or a part of one is cut into at once.
FAN = 64
#: Blocks whose balls are held against a query group at once.
CHUNK = 1024
#: No score is beyond this, nor below its negative; so scores can be negated.
MOST = 2**63 - 1
NOTHING = np.iinfo(np.int64).min


@dataclass
class Tree:
    """Points in tree order; node ``i`` covers ``lo[i]:hi[i]`` from ``centre[i]``."""

    points: np.ndarray
    ids: np.ndarray
    centre: list[int] = field(default_factory=list)
    radius: list[float] = field(default_factory=list)
    lo: list[int] = field(default_factory=list)
    hi: list[int] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - centre) ** 2).sum(axis=1))


def cover_tree(points: np.ndarray, ids: np.ndarray) -> Tree:
    """Cover tree of ``points``, built level by level from farthest-first nets.

    Children lie apart by the covering radius of their level. Where that leaves
    hardly two points together there is no structure to use, and the node is a
    leaf; a leaf's products are taken at once.
    """
    order = np.arange(len(points))
    values = points.astype(np.float64)
    nodes: list[tuple[int, float, int, int, list[int]]] = []

    def add(lo: int, hi: int, centre: int) -> int:
        here = order[lo:hi]
        away = _distances(values[here], values[centre])
        radius = float(away.max())
        node = len(nodes)
        nodes.append((centre, radius, lo, hi, []))
        if hi - lo <= LEAF or radius == 0:
            return node
        centres, nearest = [centre], np.zeros(hi - lo, np.int64)
        while away.max() > radius / BASE:
            if len(centres) * 4 > hi - lo:
                return node
            far = int(here[int(away.argmax())])
            other = _distances(values[here], values[far])
            nearest[other < away] = len(centres)
            away = np.minimum(away, other)
            centres.append(far)
        # Neighbourhoods of a few points share one leaf around the parent's centre.
        counts = np.bincount(nearest, minlength=len(centres))
        own = np.where(counts[nearest] > LEAF // 4, nearest, len(centres))
        sort = np.argsort(own, kind="stable")
        order[lo:hi] = here[sort]
        bounds = lo + np.searchsorted(own[sort], np.arange(len(centres) + 2))
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            if a < b and b - a < hi - lo:
                nodes[node][4].append(add(int(a), int(b), centres[k] if k < len(centres) else centre))
        return node

    add(0, len(points), 0)
    place = np.empty(len(points), np.int64)
    place[order] = np.arange(len(points))
    return Tree(
        points[order], ids[order],
        [int(place[n[0]]) for n in nodes], [n[1] for n in nodes],
        [n[2] for n in nodes], [n[3] for n in nodes], [n[4] for n in nodes],
    )


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of ``a`` and ``b``, held within ``MOST``."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    if np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * a.shape[1] < 2**53:
        return (x @ y.T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -MOST, MOST).astype(np.int64)


class Best:
    """The k best candidates of each query so far: higher score, then smaller id."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(queries)]

    def offer(self, first: int, query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        ahead = scores >= self.floor[first : first + len(scores), None]
        ahead &= query_ids[:, None] != ids[None, :]
        for row in np.flatnonzero(ahead.any(axis=1)):
            old_scores, old_ids = self.found[first + row]
            s = np.concatenate([old_scores, scores[row][ahead[row]]])
            i = np.concatenate([old_ids, ids[ahead[row]]])
            top = np.lexsort((i, -s))[: self.k]
            self.found[first + row] = s[top], i[top]
            if len(top) == self.k:
                self.floor[first + row] = max(self.floor[first + row], s[top[-1]])


def _reach(q: Tree, a: int, qn: np.ndarray, d: Tree, b: int, dn: np.ndarray) -> float:
    """No product between the two nodes' balls is greater."""
    x, y = q.points[q.centre[a]].astype(np.float64), d.points[d.centre[b]].astype(np.float64)
    bound = x @ y + qn[q.centre[a]] * d.radius[b] + dn[d.centre[b]] * q.radius[a]
    bound += q.radius[a] * d.radius[b]
    # Large products may cancel, so rounding is held against the lengths.
    lengths = (qn[q.centre[a]] + q.radius[a]) * (dn[d.centre[b]] + d.radius[b])
    return bound + 1e-9 * lengths + 1e-6


def dual_search(queries: Tree, data: Tree, k: int, floor: np.ndarray) -> Best:
    """Each query's k best of ``data`` among those that reach its ``floor``."""
    best = Best(len(queries.ids), k, floor)
    qn = np.sqrt((queries.points.astype(np.float64) ** 2).sum(axis=1))
    dn = np.sqrt((data.points.astype(np.float64) ** 2).sum(axis=1))
    pairs = [(_reach(queries, 0, qn, data, 0, dn), 0, 0)]
    while pairs:
        reach, a, b = pairs.pop()
        lo, hi = queries.lo[a], queries.hi[a]
        if reach < best.floor[lo:hi].min():
            continue
        split_a, split_b = queries.children[a], data.children[b]
        if not split_a and not split_b:
            ids = data.ids[data.lo[b] : data.hi[b]]
            scores = products(queries.points[lo:hi], data.points[data.lo[b] : data.hi[b]])
            best.offer(lo, queries.ids[lo:hi], ids, scores)
        elif split_b and (not split_a or data.radius[b] >= queries.radius[a]):
            pairs += sorted((_reach(queries, a, qn, data, c, dn), a, c) for c in split_b)
        else:
            pairs += sorted((_reach(queries, c, qn, data, b, dn), c, b) for c in split_a)
    return best


def _usable(vectors: DataFrame) -> DataFrame:
    """Rows without null or non-finite components, those as integers, shorter ones padded by 0."""
    limit = float("inf")
    whole = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(limit))
    )
    rows = vectors.select("vec_id", "embedding").filter("vec_id IS NOT NULL").filter(
        F.col("embedding").isNotNull() & whole
    )
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    return rows.select("vec_id", scaled.alias("v"))


def _reached(points: np.ndarray, floor: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """The balls in which some product with one of ``points`` may reach its ``floor``."""
    norms = np.sqrt((points**2).sum(axis=1))[:, None]
    lengths = np.sqrt((centres**2).sum(axis=1))
    reach = points @ centres.T + norms * radii[None, :]
    # Large products may cancel, so rounding is held against the lengths.
    reach += 1e-9 * norms * (lengths + radii)[None, :] + 1e-6
    return (reach >= floor[:, None]).any(axis=0)


def _matrix(column: pd.Series, size: int) -> np.ndarray:
    out = np.zeros((len(column), size), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, c = points.astype(np.float64), centres.astype(np.float64)
    square = (p**2).sum(axis=1)[:, None] - 2 * p @ c.T + (c**2).sum(axis=1)[None, :]
    cell = square.argmin(axis=1)
    return cell, np.sqrt(((p - c[cell]) ** 2).sum(axis=1))


def _chained(points: np.ndarray) -> np.ndarray:
    """``points`` in an order where each is the nearest of those left to the one before."""
    values, left, order = points.astype(np.float64), np.arange(1, len(points)), [0]
    while len(left):
        at = int(_distances(values[left], values[order[-1]]).argmin())
        order.append(int(left[at]))
        left = np.delete(left, at)
    return points[order]


def _trees(rows: DataFrame, size: int, keys: dict[str, str], name: str) -> DataFrame:
    """The cover tree of each group of ``keys``, with its root's ball."""

    def build(block: pd.DataFrame) -> pd.DataFrame:
        tree = cover_tree(_matrix(block["v"], size), block["vec_id"].to_numpy(np.int64))
        place = {key: [block[key].iat[0]] for key in keys}
        ball = {"centre": [tree.points[tree.centre[0]].tolist()], "radius": [tree.radius[0]]}
        return pd.DataFrame({**place, name: [pickle.dumps(tree)], **ball})

    typed = ", ".join(f"{key} {kind}" for key, kind in keys.items())
    return rows.groupBy(*keys).applyInPandas(build, f"{typed}, {name} binary, centre array<bigint>, radius double")


def _cut(placed: DataFrame, size: int, block_rows: int) -> DataFrame:
    """``placed`` with a ``block`` of about ``block_rows`` near rows in each cell, and its ``path``.

    Block 0 of a crowded cell is a sample of it and has the empty path. The other rows
    are cut around sampled vectors, level by level; a path lists the parts a row fell
    into. Where no two different vectors are drawn, or one part keeps nine tenths of the
    rows, as with copies, rows are dealt to blocks by hash.
    """

    def nearest(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        # Parts that are near get near numbers, so that queries of neighbouring paths are alike.
        around = _chained(_matrix(pd.Series(list(wanted["centres"].iat[0])), size))
        part, _ = _nearest(_matrix(rows["v"], size), around)
        return rows.drop(columns="portion").assign(path=[p + f"{k:04d}" for p, k in zip(rows["path"], part)])

    keys = ["cell", "path"]
    in_all = F.col("n")
    counts = saved(placed.groupBy("cell").agg(F.count("*").alias("n")), "cover-counts")
    # A row per cell, and there are at most MOST_CENTRES.
    rows = placed.join(F.broadcast(counts), "cell")
    # Copies under one id may be many, so the row's place counts too. It is written once,
    # for a task that is run again behind a shuffle would meet its rows in another order.
    seat = F.xxhash64("vec_id", F.monotonically_increasing_id())
    rows = rows.select("cell", "vec_id", "v", "n", F.lit("").alias("path"), seat.alias("seat"))
    rows = saved(rows, "cover-seats")
    names = ["cell", "vec_id", "v", "path", "seat"]
    aside = F.pmod("seat", in_all) < block_rows
    settled = []
    open_ = rows.filter(~aside).select(*names, F.lit(MOST).alias("was"))
    while True:
        leaves = open_.groupBy(*keys, "was").agg(F.count("*").alias("n"))
        # A part with most of what was cut is one of copies, or too large for doubles to tell apart.
        leaves = leaves.filter((in_all > 2 * block_rows) & (in_all < 0.9 * F.col("was"))).drop("was")
        parts = F.least(F.lit(FAN), F.ceil(in_all / block_rows) + 1)
        drawn = open_.join(leaves, keys).filter(F.pmod(F.xxhash64("v", "path"), in_all) < parts)
        # Equal vectors are drawn together and are one centre.
        centres = drawn.groupBy(*keys, "n").agg(F.sort_array(F.collect_set("v")).alias("centres"))
        centres = saved(centres.filter(F.size("centres") > 1), "cover-centres")
        settled.append(open_.join(centres, keys, "left_anti").select(*names))
        if centres.isEmpty():
            break
        portions = F.ceil(in_all / block_rows)
        split = open_.drop("was").join(centres.select(*keys, in_all.alias("was"), portions.alias("portions")), keys)
        split = split.withColumn("portion", F.pmod("seat", "portions")).drop("portions")
        each = F.explode(F.sequence(F.lit(0).cast("long"), portions - 1)).alias("portion")
        wanted = centres.select(*keys, each, "centres")
        split = split.groupBy(*keys, "portion").cogroup(wanted.groupBy(*keys, "portion"))
        schema = "cell int, vec_id long, v array<bigint>, path string, seat long, was long"
        open_ = saved(split.applyInPandas(nearest, schema), "cover-split")

    rest = reduce(DataFrame.union, settled)
    # A row per path, in the order of their places.
    paths = rest.groupBy(*keys).agg(F.ceil(F.count("*") / (2 * block_rows)).alias("salts"))
    before = Window.partitionBy("cell").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    paths = paths.withColumn("first", F.coalesce(F.sum("salts").over(before), F.lit(0)) + 1)
    numbered = rest.join(paths, keys).withColumn("block", F.col("first") + F.pmod("seat", "salts"))
    sample = rows.filter(aside).withColumn("block", F.lit(0).cast("long"))
    names = [*names[:-1], "block"]
    return sample.select(*names).union(numbered.select(*names))


def _query_groups(asking: DataFrame, group_rows: int) -> DataFrame:
    """``asking`` with the ``part`` of its cell it asks in: near paths together, hot ones by hash."""
    paths = asking.groupBy("cell", "path").agg(F.count("*").alias("n"))
    before = Window.partitionBy("cell").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / group_rows)
    paths = paths.select("cell", "path", ahead.alias("part"), F.ceil(F.col("n") / group_rows).alias("salts"))
    salt = F.pmod(F.xxhash64("vec_id"), F.col("salts"))
    return asking.join(paths, ["cell", "path"]).select("vec_id", "v", "cell", "part", salt.alias("salt"))


def _searched(meetings: DataFrame, k: int) -> DataFrame:
    """Each query's best of each block its group meets."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for query, data, floor in zip(batch["query"], batch["data"], batch["floor"]):
                queries = pickle.loads(query)
                least = np.frombuffer(floor, np.int64) if floor else np.full(len(queries.ids), NOTHING)
                best = dual_search(queries, pickle.loads(data), k, least)
                yield pd.DataFrame(
                    [
                        (int(q), int(i), int(s))
                        for q, (scores, ids) in zip(queries.ids, best.found)
                        for s, i in zip(scores, ids)
                    ],
                    columns=["query_id", "vec_id", "score"],
                )

    return meetings.select("query", "data", "floor").mapInPandas(
        search, "query_id long, vec_id long, score long"
    )


def _members(grouped: DataFrame) -> DataFrame:
    """The queries of each group, in the order of its tree."""

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for group, query in zip(batch["group"], batch["query"]):
                ids = pickle.loads(query).ids
                yield pd.DataFrame({"group": group, "at": np.arange(len(ids)), "query_id": ids})

    return grouped.select("group", "query").mapInPandas(names, "group long, at int, query_id long")


def _floors(members: DataFrame, worst: DataFrame) -> DataFrame:
    """Each group's ``scores`` to reach, from a score of each query that has one."""
    score = F.coalesce("score", F.lit(NOTHING)).alias("score")
    known = members.join(worst, "query_id", "left").groupBy("group")
    known = known.agg(F.sort_array(F.collect_list(F.struct("at", score))).alias("known"))
    return known.select("group", F.col("known.score").alias("scores"))


def _led(asked: DataFrame, data: DataFrame, k: int, size: int, at_once: int) -> DataFrame:
    """Each query's k-th score in the one block it asks, where that has so many."""

    def ask(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        tree = cover_tree(_matrix(queries["v"], size), queries["query_id"].to_numpy(np.int64))
        best = dual_search(tree, pickle.loads(block["data"].iat[0]), k, np.full(len(tree.ids), NOTHING))
        worst = [(int(q), int(scores[-1])) for q, (scores, _) in zip(tree.ids, best.found) if len(scores) == k]
        return pd.DataFrame(worst, columns=["query_id", "score"])

    # Many queries may ask one block, so it is met in portions.
    keys = ["cell", "block"]
    portions = asked.groupBy(*keys).agg(F.ceil(F.count("*") / at_once).alias("portions"))
    dealt = asked.join(portions, keys).withColumn("portion", F.pmod(F.xxhash64("query_id"), F.col("portions")))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("portions") - 1)).alias("portion")
    blocks = data.select(*keys, "data").join(portions.select(*keys, each), keys)
    # A portion may have got no query.
    blocks = blocks.join(dealt.select(*keys, "portion").distinct(), [*keys, "portion"], "left_semi")
    met = dealt.drop("portions").groupBy(*keys, "portion").cogroup(blocks.groupBy(*keys, "portion"))
    return met.applyInPandas(ask, "query_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k)


def top_inner_products(
    vectors: DataFrame, k: int = 5, every: int = 50, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The ``k`` best rows for each query: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Queries are the rows whose ``vec_id`` is divisible by ``every``, candidates
    all rows of another ``vec_id``. Rows repeated under one id are candidates
    each, and ask once. Vectors that are null or hold a null or non-finite
    component take no part, nor do rows without id; shorter vectors count as
    padded by zeros. Components beyond 64 bits count as the nearest number
    there is, and scores beyond 2^63 - 1 either way as that. Of different vectors under one id the least asks. An empty table gives an
    empty result.

    A query group first meets block 0 of its own cell, a sample of it, and each query the
    block that its vector points to. The scores found there are the floors that all other
    blocks, those of its cell included, have to reach.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = saved(_usable(vectors), "cover-vectors")
    totals = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("size")).first()
    size = totals["size"] or 0
    if not totals["n"] or not size:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    wanted = min(MOST_CENTRES, max(1, math.ceil(totals["n"] / block_rows)))
    # At most MOST_CENTRES rows.
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(wanted).toPandas()
    centres = np.unique(_matrix(sample["v"], size), axis=0)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, away = _nearest(_matrix(batch["v"], size), centres)
            yield batch.assign(cell=cell, away=away)

    placed = saved(
        rows.mapInPandas(place, "vec_id long, v array<bigint>, cell int, away double"), "cover-cells"
    )
    radii = np.full(len(centres), -1.0)
    for r in placed.groupBy("cell").agg(F.max("away").alias("away")).collect():  # a row per centre
        radii[r["cell"]] = r["away"]

    rows = saved(_cut(placed, size, block_rows), "cover-blocks")
    data = saved(_trees(rows, size, {"cell": "int", "block": "long"}, "data"), "cover-data")
    asking = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id")
    asking = asking.agg(F.min(F.struct("v", "cell", "path")).alias("least")).select("vec_id", "least.*")
    parts = _query_groups(asking, max(1, block_rows // 4))
    queries = _trees(parts, size, {"cell": "int", "part": "long", "salt": "long"}, "query")
    queries = saved(queries.select("cell", "query"), "cover-queries").withColumn("home", F.col("cell"))

    first = queries.join(data.filter("block = 0"), "cell").withColumn("floor", F.lit(None).cast("binary"))
    near = saved(_ranked(_searched(first, k), k), "cover-near")

    grouped = saved(queries.withColumn("group", F.monotonically_increasing_id()), "cover-groups")
    # A row per centre. A cell's balls are dealt to as many chunks as their number asks for.
    chunks = np.zeros(len(centres), np.int64)
    for r in data.groupBy("cell").agg(F.count("*").alias("n")).collect():
        chunks[r["cell"]] = -(-r["n"] // CHUNK)
    of_cells = F.element_at(F.array(*[F.lit(int(n)) for n in np.maximum(chunks, 1)]), F.col("cell") + 1)
    ball = F.struct("block", "centre", "radius")
    balls = data.withColumn("chunk", F.pmod(F.col("block"), of_cells)).groupBy("cell", "chunk")
    balls = saved(balls.agg(F.sort_array(F.collect_list(ball)).alias("balls")), "cover-balls")

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for home, query, scores in zip(batch["home"], batch["query"], batch["scores"]):
                floor = np.asarray(scores, np.int64)
                points = pickle.loads(query).points.astype(np.float64)
                useful = _reached(points, floor, centres.astype(np.float64), radii) & (radii >= 0)
                cells = np.repeat(np.flatnonzero(useful), chunks[useful])
                chunk = [c for n in chunks[useful] for c in range(n)]
                ask = {"query": query, "floor": floor.tobytes()}
                yield pd.DataFrame({"home": home, "cell": cells, "chunk": chunk, **ask})

    def held(floors: DataFrame) -> DataFrame:
        """Query groups beside the balls of the cells they have to visit."""
        waiting = grouped.join(floors, "group").select("home", "query", "scores")
        visited = waiting.mapInPandas(visits, "home int, cell int, chunk long, query binary, floor binary")
        return visited.join(balls, ["cell", "chunk"])

    def point(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cell, query, told in zip(*(batch[c] for c in ("cell", "query", "balls"))):
                tree = pickle.loads(query)
                around = _matrix(pd.Series([b["centre"] for b in told]), size).astype(np.float64)
                along = tree.points.astype(np.float64) @ around.T
                block = np.array([b["block"] for b in told])[along.argmax(axis=1)]
                yield pd.DataFrame({"query_id": tree.ids, "cell": cell, "block": block, "along": along.max(axis=1)})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for home, cell, query, scores, told in zip(*(batch[c] for c in ("home", "cell", "query", "floor", "balls"))):
                points = pickle.loads(query).points.astype(np.float64)
                around = _matrix(pd.Series([b["centre"] for b in told]), size).astype(np.float64)
                away = np.array([b["radius"] for b in told])
                block = np.array([b["block"] for b in told])
                useful = _reached(points, np.frombuffer(scores, np.int64), around, away)
                useful &= (block > 0) | (home != cell)
                yield pd.DataFrame({"cell": cell, "block": block[useful], "query": query, "floor": scores})

    members = saved(_members(grouped), "cover-members")
    worst = near.filter(F.col("rank") == k).select("query_id", "score")
    pointed = held(_floors(members, worst)).mapInPandas(point, "query_id long, cell int, block long, along double")
    where = F.max_by(F.struct("cell", "block"), F.struct("along", "cell", "block")).alias("at")
    asked = pointed.groupBy("query_id").agg(where).select("query_id", "at.*")
    ask = asking.select(F.col("vec_id").alias("query_id"), "v").join(asked, "query_id")
    led = _led(saved(ask, "cover-asked"), data, k, size, block_rows)
    worst = saved(worst.union(led).groupBy("query_id").agg(F.max("score").alias("score")), "cover-floors")

    met = held(_floors(members, worst)).mapInPandas(meet, "cell int, block long, query binary, floor binary")
    second = met.join(data.select("cell", "block", "data"), ["cell", "block"])
    far = _searched(second, k)
    best = _ranked(near.drop("rank").unionByName(far), k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_cover_trees(spark, sf_dir):
    return top_inner_products(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH usable AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
  FROM usable q JOIN usable d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id
)
SELECT query_id,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM scored
QUALIFY rank <= 5
"""
