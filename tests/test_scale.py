"""Plans that stay bounded where a table grows: what is joined, written out and run how often."""

import contextlib
import io
import uuid

import numpy as np
from pyspark.sql import functions as F

from posequarry import sinks
from posequarry.operators import clustering, contacts, fitting, progress
from posequarry.plans import driver_tables
from posequarry.sources import text_lines


def explained(df):
    with contextlib.redirect_stdout(out := io.StringIO()):
        df.explain("extended")
    return out.getvalue()


def test_radius_join_broadcasts_no_copies(spark, tmp_path):
    spark.range(40).selectExpr("string(id % 4) pdb", "double(id) x", "double(0) y", "double(0) z").write.parquet(str(tmp_path / "atoms"))
    atoms = spark.read.parquet(str(tmp_path / "atoms"))
    ligand = atoms.where("x < 4")
    hits = contacts.within_radius(atoms, ligand, 7.0)
    assert "Broadcast" not in explained(hits)
    want = [(str(i % 4), float(i)) for i in range(40) if abs(i - i % 4) <= 7]
    assert sorted((r["pdb"], r["x"]) for r in hits.collect()) == sorted(want)


def test_structure_text_is_written_once(spark):
    lines = driver_tables.structure_lines(spark, "/root/testdata/sf0.001")
    atoms = contacts.parsed_atoms(lines).groupBy("pdb", "chain", "residue", "atom_name").count()
    plan = explained(atoms).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    # Five padded fields, each named once however many are cut from the line.
    assert plan.count("lpad(") == 5


def test_batches_beyond_a_task_take_few_jobs(spark):
    """Epochs whose schedules are sorted together run as one chain of steps, however many steps that is."""
    draw = np.random.default_rng(4)
    rows = [(c, "val" if i % 5 == 0 else "train", f"{i:03d}", *map(float, draw.normal(size=3))) for c in "ab" for i in range(300)]
    frame = spark.createDataFrame(rows, "config string, part string, pdb string, y double, x0 double, x1 double")
    context = spark.sparkContext
    context.setJobGroup("few-jobs", "fit")
    try:
        found = fitting.fit_weights(frame, "softplus", epochs=20, lr=0.05, validate=True, batch=8, task_rows=10).collect()
        jobs = len(context.statusTracker().getJobIdsForGroup("few-jobs"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 40
    want = fitting.fit_weights(frame, "softplus", epochs=20, lr=0.05, validate=True, batch=8).collect()
    close = {(r["config"], r["position"]): r["weight"] for r in want}
    assert len(found) == len(close) and all(abs(close[r["config"], r["position"]] - r["weight"]) < 1e-9 for r in found)


def test_schedule_in_several_parts(spark, monkeypatch):
    draw = np.random.default_rng(5)
    rows = [("a", "val" if i % 4 == 0 else "train", f"{i % 90:03d}", *map(float, draw.normal(size=2))) for i in range(200)]
    frame = spark.createDataFrame(rows, "config string, part string, pdb string, y double, x0 double")
    want = [r["weight"] for r in fitting.fit_weights(frame, "softplus", epochs=7, lr=0.05, validate=True, batch=16).collect()]
    monkeypatch.setattr(fitting, "EPOCH_ROWS", 320)
    got = [r["weight"] for r in fitting.fit_weights(frame, "softplus", epochs=7, lr=0.05, validate=True, batch=16, task_rows=10).collect()]
    assert np.allclose(got, want, atol=1e-9)


def test_stores_are_sorted_in_ranges_of_bounded_size(spark, tmp_path, monkeypatch):
    """However few shuffle partitions the session has, a task sorts no more than a range."""
    monkeypatch.setattr(sinks, "MOST_BYTES", 2_000)
    poses = spark.range(4_000).selectExpr("'main' dataset", "format_string('%04d', id % 7) pdb", "id row_idx", "double(id) score")
    sinks.write_clustered(poses, str(tmp_path / "docking"))
    files = sorted((tmp_path / "docking").rglob("*.parquet"))
    assert len(files) >= 50
    found = [r for f in files for r in spark.read.parquet(str(f)).select("pdb", "row_idx").collect()]
    assert found == sorted(found) and len(set(found)) == 4_000


def test_ranges_follow_the_size_of_a_table(spark):
    assert sinks.ranges(spark.range(1_000).selectExpr("id", "string(null) text")) == 8
    assert sinks.ranges(spark.range(100_000_000)) == 24
    assert sinks.ranges(spark.range(10_000_000_000)) == 597
    assert sinks.ranges(spark.range(0).selectExpr('id', 'string(id) text')) == 8


def test_poses_of_complete_runs_are_not_shuffled(spark, tmp_path):
    """The ids of complete runs are few, whatever the poses weigh."""
    poses = spark.range(20_000).selectExpr(
        "format_string('%04d', id % 400) pdb", "if(id < 12000, 'a', 'b') type", "id row_idx", "rand(1) score"
    )
    poses.write.parquet(str(tmp_path / "poses"))
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        found = progress.extract_complete(spark.read.parquet(str(tmp_path / "poses")), 30, ["a"])
        assert "BroadcastHashJoin" in (plan := explained(found)) and "Exchange hashpartitioning" not in plan
        assert found.count() == 20_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)

def test_lines_are_numbered_without_sorting_them(spark, tmp_path):
    """Only the counts of splits are put in order and held, though too many to broadcast."""
    for pdb in ("1abc", "2def"):
        for part in range(3):
            (tmp_path / f"pdb={pdb}").mkdir(exist_ok=True)
            (tmp_path / f"pdb={pdb}" / f"part-{part}.txt").write_text("".join(f"{part * 10 + i}\n" for i in range(10)))
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pdb = F.regexp_extract("path", "pdb=([^/]+)/", 1)
        found = text_lines.number_lines(text_lines.read_lines(spark, str(tmp_path)), pdb)
        assert "SortMergeJoin" not in (plan := explained(found)) and "ShuffledHashJoin" in plan
        got = found.select(pdb, "line_no", F.col("line").cast("int")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)
    assert sorted(map(tuple, got)) == [(pdb, i, i) for pdb in ("1abc", "2def") for i in range(30)]


def test_small_slices_and_blocks_share_calls(spark, tmp_path, monkeypatch):
    """A call handles as many slices and blocks of a cell as make up those of the usual size."""
    draw = np.random.default_rng(6)
    rows = [(pdb, i, float(draw.normal()), draw.normal(size=6).tolist()) for pdb in "ab" for i in range(300)]
    poses = spark.createDataFrame(rows, "pdb string, row_idx long, score double, xyz array<double>")
    (calls := tmp_path / "calls").mkdir()

    def counted(cutoff, nearest=clustering._nearest):
        def run(poses, leaders):
            (calls / uuid.uuid4().hex).touch()
            return nearest(cutoff, poses, leaders)

        return run

    monkeypatch.setattr(clustering, "_nearest_leader", counted)
    got = clustering.cluster_poses(poses, 1.5, group_rows=40, head_rows=8, slice_rows=4, block_rows=2).collect()
    cells = 2 * 4**3
    assert 0 < len(list(calls.iterdir())) <= cells
    assert sorted(got) == sorted(clustering.cluster_poses(poses, 1.5).collect())


def test_schedule_in_ranges_and_chunks(spark, monkeypatch):
    """Rows are put in order by chunks and merged by ranges of places; repeated keys keep the order of y."""
    monkeypatch.setattr(fitting, "RANGE_ROWS", 20)
    monkeypatch.setattr(fitting, "CHUNK_ROWS", 16)
    draw = np.random.default_rng(6)
    rows = [(c, "val" if i % 4 == 0 else "train", f"{i % 70}", *map(float, draw.normal(size=3))) for c in "ab" for i in range(160)]
    frame = spark.createDataFrame(rows, "config string, part string, pdb string, y double, x0 double, x1 double")
    options = {"kind": "softplus", "epochs": 6, "lr": 0.05, "validate": True, "batch": 16}
    fits = [fitting.fit_weights(frame, **options, task_rows=n).orderBy("config", "position").collect() for n in (10**6, 10)]
    assert np.allclose(*[[r["weight"] for r in fit] for fit in fits], atol=1e-9)


def test_schedule_without_keys(spark):
    """Rows without a key come first in every epoch, in the order of y."""
    draw = np.random.default_rng(7)
    table = draw.normal(size=(50, 2))
    frame = spark.createDataFrame([("a", "train", None, *map(float, r)) for r in table], "config string, part string, pdb string, y double, x0 double")
    got = fitting.fit_weights(frame, "softplus", epochs=3, lr=0.05, batch=16, task_rows=10).first()["weight"]
    model, table = fitting.Softplus(fitting.start_weights(1, 42), 0.05), table[np.argsort(table[:, 0])]
    for s in [*range(0, 50, 16)] * 3:
        x, y = table[s : s + 16, 1:], table[s : s + 16, 0]
        model.step(np.sign(x @ model.weights - y) @ x / len(y))
    assert abs(got - model.weights[0]) < 1e-9
