"""Range and nearest-neighbour joins on a grid of cells, and one-to-one matching.

A range join puts rows in cells as wide as the radius, copies one side to the cells around it, joins on the cell (a
plain equi-join, which Spark can split where one cell is crowded) and tests the distance after. Where each row has a
radius of its own, cells come in levels of half the width each, so few wide rows don't make all cells wide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..exprs import mean_sigma
from ..sources.tables import settle

#: Own cell, and half of the cells around it: each pair of cells once.
_HALF = ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))
_AROUND = tuple((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1))

#: Finest level of cells: 2**20 times narrower than the widest row's.
_LEVELS = 20

#: Levels of the nearest join's quadtree, of a quarter of the width each: its finest cells are 2**30 times narrower than the box.
_DEPTH = 30
_TREE = tuple(range(0, _DEPTH + 1, 2))

#: Going down ends early once the rows left have in all at most this many candidates for each right row, and none has
#: more than the second number.
_LINEAR, _WIDEST = 4, 100_000

#: Pairs of one group that one task matches.
MATCHED = 1_000_000


def distance(ax, ay, bx, by) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def _cells(df: DataFrame, size: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(size)).withColumn("_cx", F.floor(F.col("x") / F.col("_size"))).withColumn("_cy", F.floor(F.col("y") / F.col("_size")))


def _around(df: DataFrame, offsets) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in offsets])
    return df.withColumn("_s", F.explode(steps)).withColumn("_cx", F.col("_cx") + F.col("_s.a")).withColumn("_cy", F.col("_cy") + F.col("_s.b"))


def neighbor_pairs(locs: DataFrame, n_sigma: float = 3.0, by: list[str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """i < j, d, r: rows closer than r = n_sigma (s_i + s_j), s being the mean sigmas. ``by`` keeps pairs inside groups.
    Columns of rows to ``carry`` come as c_i and c_j.

    A row's level is how often the widest row's s can be halved and still be at least its own, up to ``_LEVELS``. A
    pair meets in the cells of its wider row's level: rows look around at their own level, and stand in their own cell
    at each level that has rows, up to the widest. Two rows of one level meet once, by half of the cells around.
    """
    by, carry = by or [], carry or []
    rows = locs.select(*by, *carry, "loc_id", "x", "y", mean_sigma(F.col("sigma_x"), F.col("sigma_y")).alias("s")).filter("s is not null")
    widest = rows.agg(F.nullif(F.max("s"), F.lit(0.0)).alias("_widest"))  # without a radius nothing is near
    halvings = F.floor(F.log2(F.col("_widest") / F.col("s")) - 1e-9)
    level = F.when(F.col("s") > 0, F.greatest(F.lit(0), F.least(F.lit(_LEVELS), halvings))).otherwise(_LEVELS).cast("int")
    rows = rows.crossJoin(F.broadcast(widest)).withColumn("_own", level)
    found = rows.agg(F.collect_set("_own").alias("_levels"))  # at most _LEVELS + 1 numbers
    rows = rows.crossJoin(F.broadcast(found))
    # its own level's rows meet it apart from finer ones: same is part of the key
    finer = F.col("_own") < F.array_max("_levels")
    stand = F.transform(F.filter("_levels", lambda v: v <= F.col("_own")), lambda v: F.struct(v.alias("level"), (v == F.col("_own")).alias("same")))
    steps = lambda offsets, same: F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), F.lit(same).alias("same")) for i, j in offsets])
    look = F.when(finer, F.concat(steps(_HALF, True), steps(_AROUND, False))).otherwise(steps(_HALF, True))
    cell = lambda c, v: F.floor(F.col(c) / (F.col("_widest") * (2.0 * n_sigma) / F.pow(F.lit(2.0), v)))
    key = ["_level", "_same", "_cx", "_cy", *by]
    a = rows.withColumn("_t", F.explode(stand)).select(
        F.col("_t.level").alias("_level"), F.col("_t.same").alias("_same"), cell("x", F.col("_t.level")).alias("_cx"), cell("y", F.col("_t.level")).alias("_cy"), *by, *carry, "loc_id", "x", "y", "s"
    )
    home = F.col("_t.same") & (F.col("_t.i") == 0) & (F.col("_t.j") == 0)
    b = rows.withColumn("_t", F.explode(look)).select(
        F.col("_own").alias("_level"), F.col("_t.same").alias("_same"), (cell("x", F.col("_own")) + F.col("_t.i")).alias("_cx"), (cell("y", F.col("_own")) + F.col("_t.j")).alias("_cy"), *by,
        home.alias("_home"), F.col("loc_id").alias("lb"), F.col("x").alias("xb"), F.col("y").alias("yb"), F.col("s").alias("sb"), *[F.col(c).alias(f"_b_{c}") for c in carry],
    )
    d = distance(F.col("x"), F.col("y"), F.col("xb"), F.col("yb"))
    pairs = a.join(b, key).filter(~F.col("_home") | (F.col("loc_id") < F.col("lb"))).filter(d < n_sigma * (F.col("s") + F.col("sb")))
    first = F.col("loc_id") < F.col("lb")
    own = lambda c, k: F.when(first if k == "i" else ~first, F.col(c)).otherwise(F.col(f"_b_{c}")).alias(f"{c}_{k}")
    return pairs.select(*by, F.least("loc_id", "lb").alias("i"), F.greatest("loc_id", "lb").alias("j"), d.alias("d"), (F.col("s") + F.col("sb")).alias("s"), *[own(c, k) for c in carry for k in "ij"])


def near_links(locs: DataFrame, n_sigma: float = 3.0) -> DataFrame:
    """a, b: links that connect the same rows as ``neighbor_pairs``, a few for each row instead of each pair.

    Rows of one level are all near each other in a cell whose diagonal is the least radius there. So the smallest row
    of such a cell stands for all: they are linked to it, and pairs of rows of different cells link the rows that stand
    for them, each link once. Pairs are looked at as they are found and not kept.
    """
    s = mean_sigma(F.col("sigma_x"), F.col("sigma_y"))
    rows = locs.select("loc_id", "x", "y", "sigma_x", "sigma_y", s.alias("_s")).filter("_s is not null")
    widest = rows.agg(F.max("_s").alias("_widest"))  # one row
    level = F.floor(F.log2(F.col("_widest") / F.col("_s")) - 1e-9).cast("int")
    width = F.col("_widest") * (0.99 * n_sigma / math.sqrt(2.0)) / F.pow(F.lit(2.0), F.col("_level"))
    rows = rows.crossJoin(F.broadcast(widest)).withColumn("_level", F.when(F.col("_s") > 0, F.greatest(F.lit(0), level)))
    # in cells of numbers too large to be told apart, and without a radius, a row stands for itself
    fine = F.col("_level").isNotNull() & (F.greatest(F.abs(F.col("x") / width), F.abs(F.col("y") / width)) < float(1 << 50))
    rows = rows.withColumn("_self", F.when(~F.coalesce(fine, F.lit(False)), F.col("loc_id")))
    rows = rows.withColumns({"_level": F.coalesce("_level", F.lit(-1))} | {f"_c{a}": F.when(F.col("_self").isNull(), F.floor(F.col(a) / width)).otherwise(F.lit(0).cast("long")) for a in "xy"})
    cell = ["_level", "_cx", "_cy"]
    stands = rows.filter("_self is null").groupBy(*cell).agg(F.min("loc_id").alias("_least"))
    rows = rows.join(stands, cell, "left").withColumn("rep", F.coalesce("_self", "_least")).select("loc_id", "x", "y", "sigma_x", "sigma_y", "rep")
    between = neighbor_pairs(rows, n_sigma, carry=["rep"]).filter("rep_i != rep_j").groupBy(F.least("rep_i", "rep_j").alias("a"), F.greatest("rep_i", "rep_j").alias("b")).agg(F.lit(1).alias("_one"))
    return rows.filter("rep != loc_id").select(F.col("rep").alias("a"), F.col("loc_id").alias("b")).unionByName(between.select("a", "b"))


def scaled(pairs: DataFrame) -> DataFrame:
    """Adds pw: the distance in units of the summed mean sigmas."""
    return pairs.withColumn("pw", F.col("d") / F.col("s"))


def candidate_count(locs: DataFrame, radius: float) -> int:
    """Upper bound of the pairs within a radius, from the cells' sizes alone: the guard before pairs are kept."""
    cells = _cells(locs.select("x", "y"), locs.sparkSession.range(1).select(F.lit(radius).alias("_size"))).groupBy("_cx", "_cy").count()
    near = _around(cells, _HALF).select("_cx", "_cy", F.col("_s"), F.col("count").alias("m"))
    own = (F.col("_s.a") == 0) & (F.col("_s.b") == 0)
    total = cells.join(near, ["_cx", "_cy"]).agg(F.sum(F.when(own, F.col("count") * (F.col("count") - 1) / 2).otherwise(F.col("count") * F.col("m"))).alias("n"))
    return int(total.first()["n"] or 0)


def is_near(tau: Column | float, n_sigma: float = 3.0) -> Column:
    """Of candidate pairs (d, and both rows' variances at tau 0): whether they are near at tau."""
    t2 = F.lit(tau) * F.lit(tau) if not isinstance(tau, Column) else tau * tau
    s = F.pow((F.col("vx_i") + t2) * (F.col("vy_i") + t2), 0.25) + F.pow((F.col("vx_j") + t2) * (F.col("vy_j") + t2), 0.25)
    return F.col("d") < n_sigma * s


def pairs_at(cached: DataFrame, tau: Column | float, n_sigma: float = 3.0) -> DataFrame:
    """Those of candidate pairs that are near at tau."""
    return cached.filter(is_near(tau, n_sigma))


def candidate_pairs(locs: DataFrame, tau_max: float, n_sigma: float = 3.0, most: int | None = None) -> DataFrame:
    """Pairs that are near at the largest tau, and so hold those of all smaller ones, with both rows' variances."""
    wide = locs.withColumns({f"v{a}": F.col(f"sigma_{a}") ** 2 for a in "xy"} | {f"sigma_{a}": F.sqrt(F.col(f"sigma_{a}") ** 2 + tau_max**2) for a in "xy"})
    if most is not None:
        radius = wide.agg(F.max(mean_sigma(F.col("sigma_x"), F.col("sigma_y"))).alias("s")).first()["s"]
        if radius and (n := candidate_count(locs, 2 * n_sigma * radius)) > most:
            raise MemoryError(f"up to {n} candidate pairs, more than {most}; filter or split the rows first")
    return neighbor_pairs(wide, n_sigma, carry=["vx", "vy"]).drop("s")


def nearest(left: DataFrame, right: DataFrame, lid: str, rid: str, k: int = 1, skip_self: bool = False) -> DataFrame:
    """lid, rid, d of each left row's k nearest right rows, ties to the smaller rid. Rows without a position have none.

    Right rows are counted in the cells of a quadtree. All left rows first look around in one level's cells, the widest
    in which a right row shares its cell with few others on average, and most are done: their k-th distance is inside
    what they have looked at. The others take cells from the tree: they start at the smallest cell of their own that
    holds k rows, or at the root, and go down, leaving out cells that lie beyond the distance within which counts alone
    promise k rows, until few candidates are left. So neither a far row nor a crowded spot makes others look wider.
    """
    need = k + int(skip_self)
    r = right.select(F.col(rid).alias("_r"), F.col("x").alias("_x"), F.col("y").alias("_y")).filter("_x is not null and _y is not null")
    box = r.agg(F.count("*").alias("n"), F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"), F.max("_y").alias("y1")).first()
    if not box["n"]:
        return left.select(F.col(lid).alias(lid)).crossJoin(r.limit(0).select(F.col("_r").alias(rid), F.lit(0.0).alias("d")))
    x0, y0 = box["x0"], box["y0"]
    width = max(box["x1"] - x0, box["y1"] - y0) * (1.0 + 1e-9) or 1.0
    cells = lambda x, y, v: {"_cx": F.floor((F.col(x) - x0) / width * F.pow(F.lit(2.0), v)), "_cy": F.floor((F.col(y) - y0) / width * F.pow(F.lit(2.0), v))}
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), _DEPTH - F.col("_v"))).alias(c)
    leaves = r.withColumns(cells("_x", "_y", F.lit(_DEPTH))).groupBy("_cx", "_cy").agg(F.count("*").alias("c"))
    counts = leaves.withColumn("_v", F.explode(F.array(*map(F.lit, _TREE)))).groupBy("_v", up("_cx"), up("_cy")).agg(F.sum("c").alias("c"))
    counts = settle(counts, "counts")
    crowd = counts.groupBy("_v").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("s")).collect()  # a row a level
    start = min((w["_v"] for w in crowd if w["s"] <= 4.0 * (need + 1) * box["n"]), default=_DEPTH)

    def closest(hit: DataFrame) -> DataFrame:
        hit = hit.withColumn("d", distance(F.col("x"), F.col("y"), F.col("_x"), F.col("_y")))
        if skip_self:
            hit = hit.filter("_l != _r")
        return hit.select("_l", "_r", "d").withColumn("_k", F.row_number().over(Window.partitionBy("_l").orderBy("d", "_r"))).filter(F.col("_k") <= k)

    todo = left.select(F.col(lid).alias("_l"), "x", "y").filter("x is not null and y is not null")
    probe = _around(todo.withColumns(cells("x", "y", F.lit(start))), _AROUND).drop("_s")
    found = settle(closest(probe.join(r.withColumns(cells("_x", "_y", F.lit(start))), ["_cx", "_cy"])), "nearest")
    full = found.filter((F.col("_k") == k) & (F.col("d") <= width / 2.0**start)).select("_l")
    todo = settle(todo.join(full, "_l", "left_anti"), "nearest")
    done = found.join(full, "_l", "left_semi")
    if todo.take(1):
        wanted = _candidate_cells(todo, counts, cells, start, need, (x0, y0, width), _LINEAR * box["n"])
        used = wanted.agg(F.collect_set("_v").alias("_used"))  # at most a number for each level
        keyed = r.crossJoin(F.broadcast(used)).withColumn("_v", F.explode("_used")).withColumns(cells("_x", "_y", F.col("_v")))
        done = done.unionByName(settle(closest(wanted.join(keyed, ["_v", "_cx", "_cy"])), "nearest"))
    return done.select(F.col("_l").alias(lid), F.col("_r").alias(rid), "d")


def _candidate_cells(todo: DataFrame, counts: DataFrame, cells, start: int, need: int, box: tuple[float, float, float], light: int) -> DataFrame:
    """_l, x, y, _v, _cx, _cy: cells of the tree that hold all ``need`` nearest rows of each row to do, and few others.

    A step opens cells a quarter as wide; a row stops where its cells hold at most ``few`` rows, and all do where they
    hold at most ``light`` together.
    """
    x0, y0, width = box
    few = 1000 + 64 * need
    above = F.array(*[F.lit(v) for v in _TREE if v <= start])
    own = todo.withColumn("_v", F.explode(above)).withColumns(cells("x", "y", F.col("_v")))
    level = own.join(counts.filter(F.col("c") >= need), ["_v", "_cx", "_cy"]).groupBy("_l").agg(F.max("_v").alias("_v"))
    two = [(a, b) for a in range(-2, 3) for b in range(-2, 3)]  # as far as the diagonal of the own cell
    near = _around(todo.join(level, "_l").withColumns(cells("x", "y", F.col("_v"))), two).drop("_s")
    root = todo.join(level.select("_l"), "_l", "left_anti").withColumns({"_v": F.lit(0), "_cx": F.lit(0).cast("long"), "_cy": F.lit(0).cast("long")})
    open_, out = near.unionByName(root.select(near.columns)), None
    by_row = Window.partitionBy("_l")
    while True:
        size = F.lit(width) / F.pow(F.lit(2.0), F.col("_v"))
        gap = lambda p, c, low: F.abs(F.col(p) - low - (F.col(c) + 0.5) * size)  # noqa: B023, E731
        inside = lambda g: F.greatest(g - size / 2, F.lit(0.0))  # noqa: B023, E731
        gx, gy, slack = gap("x", "_cx", x0), gap("y", "_cy", y0), 1e-9
        at = open_.join(counts, ["_v", "_cx", "_cy"]).withColumns({"_lo": F.hypot(inside(gx), inside(gy)), "_hi": F.hypot(gx + size / 2, gy + size / 2)})
        at = at.withColumn("_sum", F.sum("c").over(by_row.orderBy("_hi").rowsBetween(Window.unboundedPreceding, 0)))
        at = at.withColumn("_far", F.min(F.when(F.col("_sum") >= need, F.col("_hi"))).over(by_row))
        at = at.filter(F.col("_far").isNull() | (F.col("_lo") <= F.col("_far") * (1.0 + slack) + width * slack))
        at = at.withColumn("_all", F.sum("c").over(by_row)).withColumn("_open", (F.col("_all") > few) & (F.col("_v") < _DEPTH))
        cols = ["_l", "x", "y", "_v", "_cx", "_cy"]
        at = settle(at.select(*cols, "_open", "_all", "c"), "frontier")
        left = at.filter("_open").agg(F.sum("c").alias("c"), F.max("_all").alias("most")).first()
        end = left["c"] is None or (left["c"] <= light and left["most"] <= _WIDEST)
        closed = (at if end else at.filter("not _open")).select(*cols)
        out = closed if out is None else out.unionByName(closed)
        if end:
            return out
        open_ = at.filter("_open").select(*cols)
        parts = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a in range(4) for b in range(4)])
        open_ = open_.withColumn("_s", F.explode(parts)).select("_l", "x", "y", (F.col("_v") + 2).alias("_v"), (F.col("_cx") * 4 + F.col("_s.a")).alias("_cx"), (F.col("_cy") * 4 + F.col("_s.b")).alias("_cy"))


def knn_edges(locs: DataFrame, k: int = 15) -> DataFrame:
    """Undirected edges i < j of every row to its k nearest, each once."""
    b = nearest(locs, locs.withColumnRenamed("loc_id", "other"), "loc_id", "other", k, skip_self=True)
    return b.groupBy(F.least("loc_id", "other").alias("i"), F.greatest("loc_id", "other").alias("j")).agg(F.min("d").alias("d"))


def within(left: DataFrame, right: DataFrame, radius: float, by: list[str], lid: list[str]) -> DataFrame:
    """Left rows x right rows of the same group closer than a radius: lid columns, right's columns, d."""
    size = left.sparkSession.range(1).select(F.lit(float(radius)).alias("_size"))
    a = _around(_cells(left.select(*by, *lid, "x", "y"), size), _AROUND).drop("_size", "_s")
    b = _cells(right, size).withColumnsRenamed({"x": "_x", "y": "_y"}).drop("_size")
    return a.join(b, [*by, "_cx", "_cy"]).withColumn("d", distance(F.col("x"), F.col("y"), F.col("_x"), F.col("_y"))).filter(F.col("d") <= radius).drop("_cx", "_cy", "x", "y", "_x", "_y")


def halo(members: DataFrame, overlap: float) -> DataFrame:
    """Core rows of pieces (partition_id, parent_id, loc_id, x, y) and, marked is_overlap, rows of sibling pieces
    within ``overlap`` of any own row, once each."""
    side = members.select("parent_id", F.col("partition_id").alias("_own"), "x", "y")
    other = members.select("parent_id", "partition_id", "loc_id", "x", "y")
    near = within(side, other.withColumnRenamed("partition_id", "_from"), overlap, ["parent_id"], ["_own"]).filter("_own != _from")
    extra = near.select("parent_id", F.col("_own").alias("partition_id"), "loc_id").distinct().join(members.select("loc_id", "x", "y"), "loc_id")
    return other.withColumn("is_overlap", F.lit(False)).unionByName(extra.withColumn("is_overlap", F.lit(True)))


def _greedy(pairs: DataFrame, a: list[str], b: list[str], order: list[Column], by: list[str]) -> DataFrame:
    """One-to-one matches of groups that each fit a task: pairs in order, each kept if both its sides are free yet.

    A task reads its sorted groups as a stream and holds one group's taken rows.
    """

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, taken_a, taken_b = None, set(), set()
        for t in batches:
            keys = [list(zip(*[t.column(c).to_pylist() for c in cols], strict=True)) for cols in (by, a, b)]
            keep = []
            for g, x, y in zip(*keys, strict=True):
                if g != group:
                    group, taken_a, taken_b = g, set(), set()
                free = x not in taken_a and y not in taken_b
                if free:
                    taken_a.add(x)
                    taken_b.add(y)
                keep.append(free)
            yield t.filter(pa.array(keep, pa.bool_()))

    return pairs.repartition(*by).sortWithinPartitions(*by, *order, *a, *b).mapInArrow(match, pairs.schema)


def _in_rounds(pairs: DataFrame, a: list[str], b: list[str], order: list[Column], by: list[str]) -> DataFrame:
    """The same matches of groups of any size: pairs that are each other's best, over and over until none is left."""
    left, out = pairs, None
    order = [*order, *map(F.col, a), *map(F.col, b)]
    while True:
        wa, wb = Window.partitionBy(*by, *a).orderBy(*order), Window.partitionBy(*by, *b).orderBy(*order)
        best = left.withColumn("_ra", F.row_number().over(wa)).withColumn("_rb", F.row_number().over(wb)).filter("_ra = 1 and _rb = 1").drop("_ra", "_rb")
        best = settle(best, "match")
        if not best.take(1):
            return out if out is not None else best
        out = best if out is None else out.unionByName(best)
        left = left.join(best.select(*by, *a), [*by, *a], "left_anti").join(best.select(*by, *b), [*by, *b], "left_anti")
        left = settle(left, "match")


def mutual_best(pairs: DataFrame, a: list[str], b: list[str], order: list[Column], by: list[str]) -> DataFrame:
    """One-to-one matches inside each group: the best pair, then the best of what it leaves, and so on; ties by a, b.

    Without ``by`` the groups are the components of the pairs, so a chain of any length takes the same few jobs.
    Groups of up to ``MATCHED`` pairs are matched in a task each, larger ones in rounds over all of them. Names and
    ``by`` aren't null.
    """
    from .graph import connect

    keys = by
    pairs = settle(pairs, "match")
    if not by:
        ends = pairs.select(F.xxhash64(F.lit(0), *a).alias("a"), F.xxhash64(F.lit(1), *b).alias("b"))  # equal hashes only join groups
        named = connect(ends)  # all but the smallest node of each
        named = pairs.withColumn("node", F.xxhash64(F.lit(0), *a)).join(named, "node", "left").withColumn("_group", F.coalesce("component", "node"))
        pairs = settle(named.drop("node", "component"), "match")
        keys = ["_group"]
    large = settle(pairs.groupBy(*keys).count().filter(F.col("count") > MATCHED).select(*keys), "large")
    if not large.take(1):
        return settle(_greedy(pairs, a, b, order, keys), "match").drop("_group")
    small = settle(_greedy(pairs.join(large, keys, "left_anti").select(*pairs.columns), a, b, order, keys), "match")
    wide = _in_rounds(settle(pairs.join(large, keys, "left_semi").select(*pairs.columns), "match"), a, b, order, keys)
    return small.unionByName(wide).drop("_group")


def match_positions(estimates: DataFrame, truth: DataFrame, threshold: float = 0.020) -> DataFrame:
    """emitter_id, true_id, d: the nearest truth of each estimate, claimed by its closest estimate, within a threshold."""
    n = nearest(estimates, truth, "emitter_id", "true_id").filter(F.col("d") <= threshold)
    return n.withColumn("_k", F.row_number().over(Window.partitionBy("true_id").orderBy("d", "emitter_id"))).filter("_k = 1").drop("_k")
