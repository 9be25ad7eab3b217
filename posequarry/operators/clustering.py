"""Greedy leader clustering of poses by coordinate RMSD.

Poses are visited by ascending score.  A pose joins the nearest representative
opened before it when their RMSD is below the cutoff, else it opens a cluster.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posequarry.functions.coords import rmsd
from posequarry.functions.terms import quoted
from posequarry.operators.ordering import n_smallest, sequence_ids
from posequarry.session import materialize

MEMBERS = "pdb string, row_idx long, cluster_id long, is_rep boolean, rmsd double"
PLACED = "pdb string, row_idx long, score double, xyz array<double>, d array<double>, c0 long, c1 long, c2 long"
# A complex with at most GROUP_ROWS poses is clustered in one task.
GROUP_ROWS = 20_000
# Larger ones are decided a head of poses at a time, checked slice by slice; the
# head doubles from HEAD_ROWS up to GROUP_ROWS, so rounds stay few.
HEAD_ROWS = 1_000
SLICE_ROWS = 10_000
LEADERS_PER_BLOCK = 5_000
# Far-apart poses that all others know their distance to, and poses they are chosen from in a large complex.
PIVOTS, PIVOT_SAMPLE = 8, 1_000


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.empty((0, 0))


def _rmsd_to(points: np.ndarray, leader: np.ndarray) -> np.ndarray:
    """RMSD of every row to one leader; 0 when there are no atoms."""
    if points.shape[1] == 0:
        return np.zeros(len(points))
    return np.sqrt(((points - leader) ** 2).sum(axis=1) * 3.0 / points.shape[1])


def _in_order(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.sort_values(["score", "row_idx"], na_position="last", ignore_index=True)


def _far_apart(points: np.ndarray, pivots: int = PIVOTS) -> list[int]:
    """Positions of poses far from one another: each is the farthest from those before it."""
    found: list[int] = []
    finite = np.isfinite(points).all(axis=1)
    if not finite.any():
        return found
    away = np.where(finite, _rmsd_to(points, points[int(np.argmax(finite))]), -1.0)
    while len(found) < pivots and away.max() > 0:
        found.append(int(np.argmax(away)))
        away = np.minimum(away, np.where(finite, _rmsd_to(points, points[found[-1]]), -1.0))
    return found


class _Near:
    """Poses that a leader may be within some distance of, by their distances to the pivots.

    The distance of two poses is at least the difference of their distances to any third. A little slack
    covers rounding; whoever asks computes the distance itself.
    """

    def __init__(self, to_pivots: np.ndarray):
        self.to_pivots = to_pivots
        self.order = np.argsort(to_pivots[:, 0], kind="stable") if to_pivots.shape[1] else np.arange(len(to_pivots))
        self.first = to_pivots[self.order, 0] if to_pivots.shape[1] else None

    def within(self, leader: np.ndarray, reach: float, of: np.ndarray) -> np.ndarray:
        """Positions, in order, whose distance to the leader can be below both ``reach`` and their value in ``of``."""
        if self.first is None:
            return np.arange(len(self.to_pivots))
        reach = reach * (1 + 1e-9) + 1e-12
        low, high = np.searchsorted(self.first, [leader[0] - reach, leader[0] + reach])
        at = self.order[low : high + 1]
        least = np.abs(self.to_pivots[at] - leader).max(axis=1)
        return np.sort(at[least <= np.minimum(reach, of[at] * (1 + 1e-9) + 1e-12)])


def _lead(points: np.ndarray, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Representative position and RMSD of each row of an ordered group.

    Works leader by leader: each new leader is compared with the later rows that the
    pivots do not rule out, and a strictly smaller distance moves a row to it.
    """
    best = np.full(len(points), np.inf)
    rep = np.full(len(points), -1)
    pivots = _far_apart(points)
    to_pivots = np.stack([_rmsd_to(points, points[p]) for p in pivots], axis=1) if pivots else np.empty((len(points), 0))
    near = _Near(to_pivots)
    for i in range(len(points)):
        if best[i] < cutoff:
            continue
        best[i], rep[i] = 0.0, i
        later = near.within(to_pivots[i], cutoff, best)
        later = later[later > i]
        distance = _rmsd_to(points[later], points[i])
        closer = distance < np.minimum(best[later], cutoff)
        best[later[closer]] = distance[closer]
        rep[later[closer]] = i
    return rep, best


def _cluster_group(cutoff: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = _in_order(frame)
        rep, distance = _lead(_matrix(rows["xyz"]), cutoff)
        ids = rows["row_idx"].to_numpy()
        return pd.DataFrame(
            {
                "pdb": rows["pdb"],
                "row_idx": ids,
                "cluster_id": ids[rep],
                "is_rep": rep == np.arange(len(rows)),
                "rmsd": distance,
            }
        )

    return run


def _leaders_of_group(cutoff: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = _in_order(frame)
        rep, _ = _lead(_matrix(rows["xyz"]), cutoff)
        return rows.loc[rep == np.arange(len(rows))]

    return run


def _parts(labels: pd.Series) -> list[np.ndarray]:
    """Positions, in order, of the rows of each label."""
    return list(labels.groupby(labels.to_numpy()).indices.values())


def _uncovered(cutoff: float):
    def run(poses: pd.DataFrame, leaders: pd.DataFrame) -> pd.DataFrame:
        points, to_pivots = _matrix(poses["xyz"]), _matrix(poses["d"])
        places = [(np.asarray(xyz, dtype=float), np.asarray(d, dtype=float)) for xyz, d in zip(leaders["xyz"], leaders["d"])]
        # What a leader covers needs no other.
        open_to = np.full(len(poses), np.inf)
        for part in _parts(poses["slice"]):
            near, reach = _Near(to_pivots[part]), open_to[part]
            for xyz, d in places:
                at = near.within(d, cutoff, reach)
                reach[at[_rmsd_to(points[part[at]], xyz) < cutoff]] = -np.inf
            open_to[part] = reach
        return poses.loc[open_to > 0]

    return run


def _nearest_leader(cutoff: float):
    def run(poses: pd.DataFrame, leaders: pd.DataFrame) -> pd.DataFrame:
        return _nearest(cutoff, poses, leaders)

    return run


def _nearest(cutoff: float, poses: pd.DataFrame, leaders: pd.DataFrame) -> pd.DataFrame:
    """Nearest leader of each block within the cutoff opened no later than the pose, with the leader's place."""
    if poses.empty or leaders.empty:
        return poses.iloc[:0].assign(cluster_id=0, rmsd=0.0, leader_score=0.0)[
            ["pdb", "row_idx", "cluster_id", "rmsd", "leader_score"]
        ]
    leaders = _in_order(leaders.assign(score=leaders["score"].fillna(np.inf)))
    points, to_pivots = _matrix(poses["xyz"]), _matrix(poses["d"])
    score, row = poses["score"].fillna(np.inf).to_numpy(), poses["row_idx"].to_numpy()
    slices = [(part, _Near(to_pivots[part]), score[part], row[part]) for part in _parts(poses["slice"])]
    lead_score, lead_row = leaders["score"].to_numpy(), leaders["row_idx"].to_numpy()
    places = [(np.asarray(xyz, dtype=float), np.asarray(d, dtype=float)) for xyz, d in zip(leaders["xyz"], leaders["d"])]
    found = []
    for block in _parts(leaders["block"]):
        best, pick = np.full(len(poses), np.inf), np.full(len(poses), -1)
        for part, near, s, r in slices:
            least, of = best[part], pick[part]
            for k in block:
                xyz, d = places[k]
                later = near.within(d, cutoff, least)
                later = later[(s[later] > lead_score[k]) | ((s[later] == lead_score[k]) & (r[later] >= lead_row[k]))]
                distance = _rmsd_to(points[part[later]], xyz)
                closer = distance < np.minimum(least[later], cutoff)
                least[later[closer]] = distance[closer]
                of[later[closer]] = k
            best[part], pick[part] = least, of
        at = pick >= 0
        found.append(
            pd.DataFrame(
                {
                    "pdb": poses["pdb"].to_numpy()[at],
                    "row_idx": row[at],
                    "cluster_id": lead_row[pick[at]],
                    "rmsd": best[at],
                    "leader_score": lead_score[pick[at]],
                }
            )
        )
    return pd.concat(found, ignore_index=True)


CELL = ["c0", "c1", "c2"]


def _pivot_table(poses: DataFrame, sample: int = PIVOT_SAMPLE) -> DataFrame:
    """(pdb, pivots): far-apart poses of a random few of each complex."""

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        points = _matrix(frame.sort_values("row_idx")["xyz"])
        return pd.DataFrame({"pdb": [frame["pdb"].iloc[0]], "pivots": [[points[p].tolist() for p in _far_apart(points)]]})

    few = n_smallest(poses.select("pdb", "row_idx", "xyz"), ["pdb"], [F.xxhash64("row_idx"), F.col("row_idx")], sample)
    return few.select("pdb", "row_idx", "xyz").groupBy("pdb").applyInPandas(choose, "pdb string, pivots array<array<double>>")


def _along(axis: int) -> Column:
    """Distance to one of the first pivots; null where there is none or it is not finite (within the cutoff of nothing)."""
    distance = F.get("d", F.lit(axis))
    return F.when(F.abs(distance) < float("inf"), distance)


def _cell_widths(poses: DataFrame, cutoff: float, slice_rows: int) -> DataFrame:
    """Width of the cells of each complex: the cutoff, or more where poses are sparse.

    An eighth of a slice per cell leaves few groups and few copies; the middle 98 % of
    the distances give the extent, so that one far pose does not widen the cells.
    """
    spans = []
    for axis in range(len(CELL)):
        low, high = (F.percentile_approx(_along(axis), q, 1000) for q in (0.01, 0.99))
        spans.append(F.greatest(F.coalesce(high - low, F.lit(0.0)), F.lit(cutoff)))
    sparse = F.cbrt(spans[0] * spans[1] * spans[2] * (slice_rows / 8) / F.count(F.lit(1)))
    return poses.groupBy("pdb").agg(F.greatest(sparse, F.lit(cutoff * (1 + 1e-9))).alias("width"))


def _placed(poses: DataFrame, widths: DataFrame) -> DataFrame:
    """Poses with the grid cell of their distances to the first three pivots.

    Two poses within the cutoff differ by no more in their distance to any pivot, so a pose and any
    leader within the cutoff are in the same or in adjoining cells, also where all
    poses lie in one pocket and only their shapes and turns differ.
    """
    cells = {
        name: F.coalesce(F.floor(_along(axis) / F.col("width")), F.lit(0)).cast("long") for axis, name in enumerate(CELL)
    }
    return poses.join(widths, "pdb").withColumns(cells).drop("width")


def _to_neighbours(leaders: DataFrame) -> DataFrame:
    """Leaders copied to their own and the 26 adjoining cells."""
    steps = F.lit([-1, 0, 1])
    for name in CELL:
        leaders = leaders.withColumn("_step", F.explode(steps)).withColumn(name, F.col(name) + F.col("_step"))
    return leaders.drop("_step")


def _cluster_large(
    poses: DataFrame, cutoff: float, group_rows: int, head_rows: int, slice_rows: int, block_rows: int
) -> DataFrame:
    """Exact clustering of complexes too large for one task.

    The representatives are found in rounds: the lowest undecided poses of each
    complex are clustered among themselves (a bounded group), their leaders are
    checked against the undecided poses of nearby cells, and covered poses leave.
    Since leaders always precede what is still undecided, this visits poses in
    the same order as the one-task form.  Every pose then looks up its nearest
    earlier leader among those of nearby cells, which are all it can be within
    the cutoff of. Crowded cells are cut into slices, and their leaders into blocks.
    Small slices and blocks of a cell are compared one by one, but as many go to one call as make up a
    slice and a block of the usual size: each call has its cost, and its copies of leaders or poses.
    """
    per_call, blocks_per_call = max(1, SLICE_ROWS // slice_rows), max(1, LEADERS_PER_BLOCK // block_rows)
    pivots = materialize(_pivot_table(poses))
    to_pivots = F.transform("pivots", lambda v: rmsd(F.col("xyz"), v)).alias("d")
    known = materialize(poses.join(pivots, "pdb").select("pdb", "row_idx", "score", "xyz", to_pivots))
    placed = _placed(known, materialize(_cell_widths(known, cutoff, slice_rows)))
    home = ["pdb", *CELL]
    cells = materialize(
        placed.groupBy(*home)
        .agg(F.ceil(F.count(F.lit(1)) / slice_rows).cast("int").alias("slices"))
        .withColumn("calls", F.ceil(F.col("slices") / per_call).cast("int"))
    )
    rows = materialize(
        placed.join(cells, home)
        .withColumn("slice", F.pmod(F.xxhash64("row_idx"), F.col("slices")).cast("int"))
        .withColumn("call", F.floor(F.col("slice") / per_call).cast("int"))
    )
    columns = ["pdb", "row_idx", "score", "xyz", "d"]
    every_call = F.explode(F.sequence(F.lit(0), F.col("calls") - 1)).alias("call")
    undecided, rounds = rows.drop("slices", "calls"), []
    placed_pose = f"{PLACED}, slice int, call int"
    keys = [*home, "call"]
    while True:
        order = [F.col("score").asc_nulls_last(), F.col("row_idx").asc()]
        head = min(head_rows << len(rounds), group_rows)
        heads = n_smallest(undecided, ["pdb"], order, head)
        leaders = materialize(
            heads.select(*columns, *CELL).groupBy("pdb").applyInPandas(_leaders_of_group(cutoff), PLACED)
        )
        near = _to_neighbours(leaders).join(cells, home)
        rounds.append(near)
        copies = near.select(*columns, *CELL, every_call)
        # A round's own leaders are within the cutoff of themselves, but for coordinates that are not numbers.
        undecided = materialize(
            undecided.join(leaders.select("pdb", "row_idx"), ["pdb", "row_idx"], "left_anti")
            .select(*columns, *CELL, "slice", "call")
            .groupBy(*keys)
            .cogroup(copies.groupBy(*keys))
            .applyInPandas(_uncovered(cutoff), placed_pose)
        )
        if undecided.isEmpty():
            break
    leaders = reduce(DataFrame.unionByName, rounds)
    blocks = leaders.groupBy(*home).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    block_of = F.pmod(F.xxhash64("row_idx"), F.col("blocks")).cast("int").alias("block")
    call_of = F.floor(F.col("block") / blocks_per_call).cast("int").alias("block_call")
    copies = leaders.join(blocks, home).select(*columns, *CELL, every_call, block_of).select("*", call_of)
    last_call = F.floor((F.col("blocks") - 1) / blocks_per_call).cast("int")
    every_block_call = F.explode(F.sequence(F.lit(0), last_call)).alias("block_call")
    spread = rows.join(blocks, home).select(*columns, *CELL, "slice", "call", every_block_call)
    keys.append("block_call")
    nearest = (
        spread.groupBy(*keys)
        .cogroup(copies.groupBy(*keys))
        .applyInPandas(
            _nearest_leader(cutoff),
            "pdb string, row_idx long, cluster_id long, rmsd double, leader_score double",
        )
    )
    own = leaders.select(
        "pdb", "row_idx", F.col("row_idx").alias("cluster_id"), F.lit(0.0).alias("rmsd"), F.col("score").alias("leader_score")
    )
    best = nearest.unionByName(own).groupBy("pdb", "row_idx").agg(
        F.min(F.struct("rmsd", "leader_score", "cluster_id")).alias("b")
    )
    return best.select(
        "pdb",
        "row_idx",
        F.col("b.cluster_id").alias("cluster_id"),
        (F.col("row_idx") == F.col("b.cluster_id")).alias("is_rep"),
        F.col("b.rmsd").alias("rmsd"),
    )


def cluster_poses(
    poses: DataFrame,
    rmsd_cutoff: float = 2.0,
    score_col: str = "score",
    group_rows: int = GROUP_ROWS,
    head_rows: int = HEAD_ROWS,
    slice_rows: int = SLICE_ROWS,
    block_rows: int = LEADERS_PER_BLOCK,
) -> DataFrame:
    """Cluster members (pdb, row_idx, cluster_id, is_rep, rmsd).

    ``poses`` needs (pdb, row_idx, score, xyz) with atoms flattened to one
    array; poses without coordinates are left out.  ``cluster_id`` is the row of
    the representative.  A count decides per complex between the one-task form
    and the form by cells and slices, so no task ever holds an unbounded group.
    """
    if rmsd_cutoff <= 0:
        raise ValueError("rmsd_cutoff must be positive")
    valid = poses.where(F.col("xyz").isNotNull()).select(
        "pdb",
        F.col("row_idx").cast("long").alias("row_idx"),
        quoted(score_col).cast("double").alias("score"),
        F.col("xyz").cast("array<double>").alias("xyz"),
    )
    sizes = valid.groupBy("pdb").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows)
    if sizes.isEmpty():
        return valid.groupBy("pdb").applyInPandas(_cluster_group(rmsd_cutoff), MEMBERS)
    sizes = materialize(sizes)
    small = valid.join(sizes, "pdb", "left_anti")
    large = valid.join(sizes.select("pdb"), "pdb", "left_semi")
    return (
        small.groupBy("pdb")
        .applyInPandas(_cluster_group(rmsd_cutoff), MEMBERS)
        .unionByName(_cluster_large(large, rmsd_cutoff, group_rows, head_rows, slice_rows, block_rows))
    )


def cluster_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("pdb", "cluster_id").agg(F.count(F.lit(1)).alias("size"))


def cluster_statistics(members: DataFrame) -> DataFrame:
    """One row: complexes, clusters, poses, and how both distribute.

    Medians are taken over (value, frequency) pairs, whose number is bounded by
    the distinct sizes.
    """
    sizes = cluster_sizes(members)
    per_pdb = sizes.groupBy("pdb").agg(F.count(F.lit(1)).alias("value"))
    long = per_pdb.select(F.lit("pdb").alias("of"), "value").unionByName(
        sizes.select(F.lit("cluster").alias("of"), F.col("size").alias("value"))
    )
    counted = long.groupBy("of", "value").agg(F.count(F.lit(1)).alias("freq"))

    def stats(of: str, name: str) -> list:
        mine = F.when(F.col("of") == of, F.col("value"))
        weight = F.when(F.col("of") == of, F.col("freq")).otherwise(0)
        return [
            (F.sum(mine * weight) / F.sum(weight)).alias(f"mean_{name}"),
            F.percentile(mine.cast("double"), F.lit(0.5), weight).alias(f"median_{name}"),
            F.max(mine).alias(f"max_{name}"),
        ]

    is_cluster = F.col("of") == "cluster"
    single = F.sum(F.when(is_cluster & (F.col("value") == 1), F.col("freq")).otherwise(0))
    n_clusters = F.sum(F.when(is_cluster, F.col("freq")).otherwise(0))
    return counted.agg(
        F.sum(F.when(~is_cluster, F.col("freq")).otherwise(0)).alias("n_pdbs"),
        n_clusters.alias("n_clusters"),
        F.sum(F.when(is_cluster, F.col("freq") * F.col("value")).otherwise(0)).alias("n_poses"),
        *stats("pdb", "clusters_per_pdb"),
        *stats("cluster", "cluster_size"),
        single.alias("n_singletons"),
        (single / n_clusters).alias("singleton_share"),
    )


def nested_clusters(members: DataFrame, part_size: int = 10_000) -> DataFrame:
    """Export form with member and RMSD lists, nearest members first.

    A list holds at most ``part_size`` members; a larger cluster spans several
    parts, in order, so that no row grows with the data.
    """
    placed = sequence_ids(members, ["pdb", "cluster_id"], ["rmsd", "row_idx"], "place")
    part = F.floor(F.col("place") / part_size).alias("part")
    ordered = F.array_sort(F.collect_list(F.struct("place", "row_idx", "rmsd")))
    lists = placed.groupBy("pdb", "cluster_id", part).agg(ordered.alias("m"))
    return lists.select(
        "pdb",
        F.col("cluster_id").alias("representative"),
        "part",
        F.col("m.row_idx").alias("members"),
        F.col("m.rmsd").alias("rmsds"),
        F.size("m").alias("size"),
    )
