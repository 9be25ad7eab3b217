"""Leader clustering against a direct, pose-by-pose reading of the rule."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from posequarry import sinks
from posequarry.operators import aggregate, clustering
from tests.conftest import rows


def by_hand(poses, cutoff):
    out = []
    for pdb in sorted({p[0] for p in poses}):
        leaders = []
        mine = [p for p in poses if p[0] == pdb and p[3] is not None]
        for _, row, score, xyz in sorted(mine, key=lambda p: (p[2], p[1])):
            best, rep = float("inf"), None
            for lead_row, lead_xyz in leaders:
                pairs = np.reshape(xyz, (-1, 3)) - np.reshape(lead_xyz, (-1, 3))
                rmsd = float(np.sqrt((pairs**2).sum(axis=1).mean())) if len(xyz) else 0.0
                if rmsd < best:
                    best, rep = rmsd, lead_row
            if rep is not None and best < cutoff:
                out.append((pdb, row, rep, False, round(best, 9)))
            else:
                leaders.append((row, xyz))
                out.append((pdb, row, row, True, 0.0))
    return sorted(out)


def frame(spark, poses):
    return spark.createDataFrame(poses, "pdb string, row_idx long, score double, xyz array<double>")


def collected(members):
    return sorted(
        (r["pdb"], r["row_idx"], r["cluster_id"], r["is_rep"], round(r["rmsd"], 9)) for r in members.collect()
    )


@pytest.fixture(scope="module")
def random_poses():
    rng = np.random.default_rng(3)
    out = []
    for pdb, n in (("big1", 260), ("mid2", 90), ("tiny", 1)):
        centres = rng.normal(0, 3, (6, 12))
        for row in range(n):
            xyz = centres[rng.integers(6)] + rng.normal(0, 0.7, 12)
            out.append((pdb, row, float(rng.integers(40)), xyz.tolist()))
    return out


@pytest.mark.parametrize("cutoff", [0.4, 1.2, 2.5])
def test_one_task_form(spark, random_poses, cutoff):
    got = clustering.cluster_poses(frame(spark, random_poses), cutoff)
    assert collected(got) == by_hand(random_poses, cutoff)


@pytest.mark.parametrize("cutoff", [0.4, 1.2])
def test_form_by_cells_gives_the_same(spark, random_poses, cutoff):
    sizes = {"group_rows": 50, "head_rows": 8, "slice_rows": 20, "block_rows": 4}
    got = clustering.cluster_poses(frame(spark, random_poses), cutoff, **sizes)
    assert collected(got) == by_hand(random_poses, cutoff)


def test_poses_without_finite_coordinates_stand_alone(spark):
    poses = [("a", i, float(i), [float("nan") if i % 3 == 0 else i / 8, 0.0, 0.0]) for i in range(12)]
    whole = clustering.cluster_poses(frame(spark, poses), 0.3)
    cells = clustering.cluster_poses(frame(spark, poses), 0.3, group_rows=4, head_rows=2, slice_rows=2, block_rows=2)
    assert collected(cells) == collected(whole)
    assert sum(alone for _, i, _, alone, _ in collected(whole) if i % 3 == 0) == 4


def test_mostly_single_poses_meet_only_their_neighbours(spark):
    rng = np.random.default_rng(9)
    poses = [("a", i, float(i % 977), (rng.normal(size=3) * 40).tolist() * 2) for i in range(3000)]
    whole = clustering.cluster_poses(frame(spark, poses), 1.0)
    sizes = {"group_rows": 1500, "head_rows": 1000, "slice_rows": 1000, "block_rows": 500}
    assert collected(clustering.cluster_poses(frame(spark, poses), 1.0, **sizes)) == collected(whole)


def test_edges(spark):
    poses = [
        ("a", 1, -5.0, [0.0, 0.0, 0.0]),
        ("a", 2, -4.0, [2.0, 0.0, 0.0]),  # exactly at the cutoff: opens a cluster
        ("a", 3, -3.0, [1.0, 0.0, 0.0]),  # equally near to both: the first wins
        ("a", 4, -2.0, None),  # no coordinates: left out
        ("b", 1, 0.0, []),
        ("b", 2, 1.0, []),  # no atoms: distance 0
    ]
    got = collected(clustering.cluster_poses(frame(spark, poses), 2.0))
    assert got == [
        ("a", 1, 1, True, 0.0),
        ("a", 2, 2, True, 0.0),
        ("a", 3, 1, False, 1.0),
        ("b", 1, 1, True, 0.0),
        ("b", 2, 1, False, 0.0),
    ]


def test_cutoff_must_be_positive(spark):
    with pytest.raises(ValueError):
        clustering.cluster_poses(frame(spark, [("a", 1, 0.0, [0.0, 0.0, 0.0])]), 0.0)


def test_cache_adds_only_what_is_missing(spark, random_poses, tmp_path):
    cache = str(tmp_path / "cache")
    df = frame(spark, random_poses)
    sinks.cached_clusters(df.where("pdb = 'mid2'"), 1.2, cache)
    members = sinks.cached_clusters(df, 1.2, cache)
    assert collected(members) == by_hand(random_poses, 1.2)
    assert spark.read.parquet(cache).count() == len(random_poses)
    sinks.cached_clusters(df.where("pdb = 'mid2'"), 0.4, cache)
    assert spark.read.parquet(cache).where("rmsd_cutoff = 0.4").count() == 90


def test_cache_follows_every_coordinate(spark, random_poses, tmp_path):
    cache = str(tmp_path / "cache")
    sinks.cached_clusters(frame(spark, random_poses), 1.2, cache)
    moved = [(*p[:3], [p[3][0] + 50.0, *p[3][1:]]) if p[:2] == ("mid2", 7) else p for p in random_poses]
    assert collected(sinks.cached_clusters(frame(spark, moved), 1.2, cache)) == by_hand(moved, 1.2)
    scored = [(*p[:2], p[2] - 100.0, p[3]) if p[:2] == ("big1", 11) else p for p in moved]
    assert collected(sinks.cached_clusters(frame(spark, scored[::-1]), 1.2, cache)) == by_hand(scored, 1.2)
    # Superseded entries are gone, those of other complexes and of a smaller call stay.
    assert spark.read.parquet(cache).count() == len(random_poses)
    sinks.cached_clusters(frame(spark, [p for p in random_poses if p[0] == "mid2"]), 1.2, cache)
    assert spark.read.parquet(cache).where("pdb = 'big1'").count() == 260


def test_skipped_ids(spark):
    df = frame(spark, [("a", 1, 0.0, [0.0, 0.0, 0.0]), ("b", 1, 0.0, None)])
    assert rows(sinks.skipped_ids(df, clustering.cluster_poses(df, 1.0))) == [("b",)]


def test_representatives_feed_the_clustered_strategy(spark, random_poses):
    df = frame(spark, random_poses)
    members = clustering.cluster_poses(df, 1.2)
    got = aggregate.aggregate_per_pdb(df, "score", "clustered", cluster_members=members)
    reps = {(m[0], m[1]) for m in by_hand(random_poses, 1.2) if m[3]}
    want = sorted((p[0], p[2], 1.0) for p in random_poses if (p[0], p[1]) in reps)
    assert rows(got) == want


def test_statistics(spark, random_poses):
    members = clustering.cluster_poses(frame(spark, random_poses), 1.2)
    stats = clustering.cluster_statistics(members).first()
    sizes = members.groupBy("pdb", "cluster_id").count().toPandas()
    per_pdb = sizes.groupby("pdb").size()
    assert stats["n_pdbs"] == 3 and stats["n_poses"] == len(random_poses)
    assert stats["n_clusters"] == len(sizes)
    assert stats["median_clusters_per_pdb"] == np.median(per_pdb)
    assert stats["median_cluster_size"] == np.median(sizes["count"])
    assert stats["mean_cluster_size"] == pytest.approx(sizes["count"].mean())
    assert stats["n_singletons"] == (sizes["count"] == 1).sum()


def test_nested_lists_are_cut_into_parts(spark, random_poses):
    members = clustering.cluster_poses(frame(spark, random_poses), 1.2)
    whole, parts = clustering.nested_clusters(members), clustering.nested_clusters(members, 7)
    assert whole.where("part > 0").count() == 0 and parts.where("size > 7").count() == 0
    joined = parts.select("pdb", "representative", "part", F.posexplode("members").alias("i", "row"))
    lists = {}
    for r in joined.orderBy("part", "i").collect():
        lists.setdefault((r["pdb"], r["representative"]), []).append(r["row"])
    assert lists == {(r["pdb"], r["representative"]): r["members"] for r in whole.collect()}


def turned_poses(n, seed=4):
    """One molecule in one place, turned and bent at random: all centroids are equal."""
    rng = np.random.default_rng(seed)
    atoms = rng.normal(0, 4, (22, 3))
    bend = rng.normal(0, 1, (22, 3))
    q = rng.normal(size=(n, 4))
    w, x, y, z = (q / np.linalg.norm(q, axis=1, keepdims=True)).T
    turn = np.stack(
        [
            np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], 1),
            np.stack([2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], 1),
            np.stack([2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)], 1),
        ],
        1,
    )
    shape = atoms[None] + bend[None] * rng.normal(0, 0.5, (n, 1, 1))
    shape = np.einsum("nij,nkj->nki", turn, shape)
    return (shape - shape.mean(axis=1, keepdims=True)).reshape(n, -1)


def test_pivots_spare_most_pairs_within_one_pocket(monkeypatch):
    points, compared, measure = turned_poses(20_000), [], clustering._rmsd_to

    def counted(some, leader):
        compared.append(len(some))
        return measure(some, leader)

    monkeypatch.setattr(clustering, "_rmsd_to", counted)
    rep, best = clustering._lead(points, 2.0)
    pruned = sum(compared)
    compared.clear()
    monkeypatch.setattr(clustering, "_far_apart", lambda points: [])
    whole = clustering._lead(points, 2.0)
    assert len(np.unique(rep)) > 100
    assert (rep == whole[0]).all() and (best == whole[1]).all()
    assert pruned < sum(compared) / 10


def test_large_form_within_one_pocket(spark):
    points = turned_poses(1500, seed=5)
    poses = [("a", i, float(i % 311), xyz.tolist()) for i, xyz in enumerate(points)]
    whole = collected(clustering.cluster_poses(frame(spark, poses), 2.5))
    sizes = {"group_rows": 700, "head_rows": 300, "slice_rows": 200, "block_rows": 100}
    assert collected(clustering.cluster_poses(frame(spark, poses), 2.5, **sizes)) == whole
    # Cells tell poses apart though their centroids do not.
    known = frame(spark, poses).join(clustering._pivot_table(frame(spark, poses)), "pdb")
    known = known.withColumn("d", F.transform("pivots", lambda v: clustering.rmsd(F.col("xyz"), v)))
    placed = clustering._placed(known, clustering._cell_widths(known, 2.5, 200))
    assert placed.select(*clustering.CELL).distinct().count() > 15
