"""Whole runs: statistics, curation, stores, progress, features and ingest."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posequarry import sinks
from posequarry.fixed_values import FEATURE_TERMS, STAGE_TARGETS
from posequarry.operators import aggregate, annotations, features, progress, splits, structure
from posequarry.plans import experiment, feature_report
from posequarry.plans.curation import curate
from posequarry.plans.statistics import run_statistics
from posequarry.schemas import pose_schema
from posequarry.sources import bucketed, store
from posequarry.streaming import ingest
from posequarry.streaming.ingest import append_new_files
from tests.conftest import rows

TERMS = ["fa_atr", "fa_rep", "fa_sol", "fa_elec", "fa_pair", "hbond_bb_sc", "hbond_sc"]


@pytest.fixture(scope="module")
def pose_table():
    rng = np.random.default_rng(21)
    data = []
    for k in range(60):
        for i in range(30):
            row = {"dataset": "main", "pdb": f"{k:04d}", "row_idx": i}
            row["type"] = ["relax_docking_perturb", "apo_relax_docking_perturb", "crystal_docking_std"][i % 3]
            row["total_score"] = float(rng.normal(-3, 2))
            row |= {f"raw_delta_{t}": float(rng.normal(-1, 1)) for t in TERMS}
            row["idelta_score"] = sum(row[f"raw_delta_{t}"] for t in TERMS) - 3
            data.append(row)
    return pd.DataFrame(data)


def test_statistics_run(spark, pose_table, tmp_path):
    index = "# c\n" + "".join(f"{k:04d} 2.0 2001 Kd={k + 1}nM // x.pdf (L)\n" for k in range(0, 60, 2))
    (tmp_path / "index.lst").write_text(index)
    poses = spark.createDataFrame(pose_table)
    rng = np.random.default_rng(5)
    xyz = [rng.normal(0, 1, 9).tolist() for _ in range(len(pose_table))]
    coordinates = spark.createDataFrame(pose_table[["pdb", "row_idx"]].assign(xyz=xyz))
    out = str(tmp_path / "out")
    got = run_statistics(spark, str(tmp_path / "index.lst"), poses, out, coordinates, 1.5, epochs=50)
    assert got.subset.select("pdb").distinct().count() == 30
    assert got.baseline.count() == got.results.count() == 16
    assert got.weights.where("weight < 0").count() == 0
    names = {e.tag for e in [*experiment.DEFAULT_EXPERIMENTS, *experiment.clustered_experiments(1.5)]}
    assert {r["config"] for r in got.weights.select("config").collect()} == names
    assert got.weights.where("config = 'min__combined_vdw'").count() == 3
    assert got.cluster_report.first()["n_poses"] == got.subset.count()
    before = rows(got.baseline)
    again = run_statistics(spark, str(tmp_path / "index.lst"), poses, out, coordinates, 1.5, epochs=50)
    assert rows(again.baseline) == before


def test_top_terms(spark):
    named = spark.createDataFrame(
        [("c", f"raw_delta_t{i:02d}", 0.1 * i, float((i * 7) % 20)) for i in range(20)],
        "config string, energy_term string, weight double, original_weight double",
    )
    top = experiment.top_terms(named, "c").collect()
    assert len(top) == 15 and top[0]["term"] == "t17" and top[0]["original_weight"] == 19.0
    zero = experiment.weight_changes(named).where("old = 0").first()
    assert zero["quot"] is None and zero["diff"] == zero["new"]


def line(record, number, name, residue, chain, res_no, x, element):
    return f"{record:<6}{number:>5} {name:<4} {residue:>3} {chain}{res_no:>4}    {x:>8.3f}{0:>8.3f}{0:>8.3f}  1.00  0.00          {element:>2}"


def test_curation_run(spark, tmp_path):
    (tmp_path / "index.lst").write_text(
        "good 2.0 2001 Kd=1nM // g.pdf (L)\nfoul 2.0 2001 Kd=1nM // g.pdf (L)\n"
        "flag 2.0 2001 Kd=1nM // g.pdf (L) covalent\npoor 2.0 2001 Kd=1nM // g.pdf (L)\n"
    )
    ligands = spark.createDataFrame(
        [("good", 20, False, 0.5), ("foul", 20, False, 0.5), ("flag", 20, False, 0.5), ("poor", 20, False, 0.05)],
        "pdb string, heavy_atoms long, has_rare boolean, qed double",
    )
    lines = []
    for pdb in ("good", "foul", "flag", "poor"):
        body = [
            line("ATOM", 1, " N", "ALA", "A", 1, 1.0, "N"),
            line("ATOM", 2, " H", "ALA", "A", 1, 1.5, "H"),
            line("ATOM", 3, " N", "ALA", "B", 1, 60.0, "N"),
            "TER",
            line("HETATM", 4, "ZN", "ZN" if pdb == "good" else "ACE", "A", 9, 2.0, "ZN"),
        ]
        lines += [(pdb, i, text) for i, text in enumerate(body)]
    text = spark.createDataFrame(lines, "pdb string, line_no long, line string")
    points = spark.createDataFrame([(p, 0.0, 0.0, 0.0) for p in ("good", "foul", "flag", "poor")], "pdb string, x double, y double, z double")
    got = curate(spark, str(tmp_path / "index.lst"), ligands, text, points, str(tmp_path / "out"))
    assert rows(got.index) == [("good", ["A"], ["ZN  :4"])]
    assert rows(got.removed) == [("index", "covalent", 1), ("ligand", "qed", 1), ("structure", "co ligand", 1)]
    files = list((tmp_path / "out" / "structures").glob("pdb=*"))
    assert [f.name for f in files] == ["pdb=good"]
    written = "".join(p.read_text() for p in sorted(files[0].glob("part-*"))).splitlines()
    assert written == [lines[0][2], "TER", lines[4][2]]


def test_progress_and_resume(spark):
    done = {s: n for s, n in STAGE_TARGETS.items()}
    data = []
    for pdb, counts in (("full", done), ("half", {**done, "apo_relax_docking_std": 299}), ("none", {"crystal": 1})):
        data += [("main", pdb, s) for s, n in counts.items() for _ in range(n)]
    both = spark.createDataFrame(data, "dataset string, pdb string, type string")
    docking, relax = both.where(F.col("type").contains("docking")), both.where(~F.col("type").contains("docking"))
    vector = progress.progress_vector(docking, relax)
    deficits = progress.stage_deficits(vector).first()
    assert deficits["apo_relax_docking_std"] == 2 and deficits["relax"] == 1 and deficits["crystal"] == 0
    assert rows(progress.incomplete_ids(vector).select("pdb")) == [("half",), ("none",)]
    assert rows(progress.complete_ids(docking)) == [("full",)]
    every = [s for s in STAGE_TARGETS if "docking" in s]
    assert rows(progress.complete_ids(docking, 300, every)) == [("full",)]
    assert {r["pdb"] for r in progress.extract_complete(docking).select("pdb").collect()} == {"full"}
    assert rows(progress.run_status(docking, relax)) == [("full", "success"), ("half", "success"), ("none", "failed")]
    work = spark.createDataFrame([("half",), ("new",)], "pdb string")
    plan = {(r["pdb"], r["stage"]): r["remaining"] for r in progress.resume_plan(work, both).collect()}
    assert plan["half", "apo_relax_docking_std"] == 1 and plan["half", "relax"] == 0
    assert sum(v for (p, _), v in plan.items() if p == "new") == sum(STAGE_TARGETS.values())


def test_feature_table_shape_and_missing_states(spark):
    schema = [f"{p}{t} double" for p in ("raw_", "raw_delta_") for t in FEATURE_TERMS]
    columns = "pdb string, state string, row_idx long, total_score double, idelta_score double, rmsd_to_crystal double, " + ", ".join(schema)
    energies = [float(i) for i in range(50)]
    states = spark.createDataFrame(
        [("a", s, 0, -1.0 - i, -2.0, 0.5, *energies) for i, s in enumerate(features.STATES)]
        + [("a", "crystal", 1, 99.0, 99.0, 99.0, *energies), ("b", "crystal", 0, -7.0, -2.0, 0.0, *energies)],
        columns,
    )
    ids = spark.createDataFrame([("a", True), ("b", True)], "pdb string, healthy boolean")
    affinity = spark.createDataFrame(
        [("a", "train", "Kd=5nM", False), ("b", "test", "IC50>2uM", True)],
        "pdb string, new_split string, `kd/ki` string, covalent boolean",
    )
    member = spark.createDataFrame(
        [("s1", "a", "test", 2), ("s1", "a", "train", 1)], "source string, pdb string, split string, priority int"
    )
    facts = spark.createDataFrame([("a", 12, 0.4, False)], "pdb string, nres int, qed double, has_rare_element boolean")
    got = features.feature_table(ids, affinity, member, ["s1", "s2"], "s2", states, facts)
    assert len(got.columns) == 1 + 118 - 2
    a, b = got.orderBy("pdb").collect()
    assert (a["s1"], a["s2"], a["fully_relaxed"], a["crystal_total_score"]) == ("train", "train", True, -1.0)
    assert (a["relax_total_score"], a["ligaway_total_score"], a["nres"]) == (-2.0, -3.0, 12)
    assert (a["relax_total_fa_atr"], a["relax_idelta_fa_atr"]) == (9.0, 34.0)
    assert (b["s1"], b["fully_relaxed"], b["relax_total_score"], b["vague_measures"]) == (None, False, None, True)
    lost = spark.createDataFrame([("zz", True)], "pdb string, healthy boolean")
    with pytest.raises(Exception, match="missing pdb zz"):
        features.feature_table(lost, affinity, member, ["s1", "s2"], "s2", states, facts).collect()
    assert rows(splits.missing_keys(lost, affinity, "pdb")) == [("zz",)]


def test_hash_split_is_stable_and_near_its_share(spark):
    ids = spark.range(4000).select(F.col("id").cast("string").alias("pdb"))
    part = ids.select(splits.hash_split(F.col("pdb")).alias("part"))
    share = part.where("part = 'train'").count() / 4000
    assert abs(share - 0.8) < 0.03


def test_docked_text_and_coordinates(spark):
    def ligand(x):
        return f"HETATM    1  C1  UNK X   1    {x:>8.3f}{1:>8.3f}{2:>8.3f}"

    base = ["ATOM", ligand(0.0), ligand(5.0).replace(" C1 ", " C2 "), "END"]
    relax = spark.createDataFrame(
        [("a", "relax", 0, -1.0, ["bad"]), ("a", "relax", 1, -9.0, base), ("a", "crystal", 2, -99.0, ["x"])],
        "pdb string, type string, row_idx long, total_score double, lines array<string>",
    )
    poses = spark.createDataFrame(
        [("a", "relax_docking_std", 7, {1: ligand(3.5)})], "pdb string, type string, row_idx long, delta map<int,string>"
    )
    text = structure.docked_text(poses, relax)
    assert text.first()["lines"] == [base[0], ligand(3.5), base[2], "END"]
    atom_map = spark.createDataFrame([("a", " C1 ", 1), ("a", " C2 ", 0)], "pdb string, atom_name string, atom_index int")
    lines = text.select("pdb", "row_idx", F.explode("lines").alias("line"))
    got = structure.pose_coordinates(lines, atom_map).first()
    assert got["xyz"] == [5.0, 1.0, 2.0, 3.5, 1.0, 2.0]


def test_store_round_trip_and_clustering_by_id(spark, pose_table, tmp_path):
    poses = spark.createDataFrame(pose_table).withColumn("lines", F.lit("text"))
    sinks.write_clustered(poses, f"{tmp_path}/docking")
    sinks.append_poses(poses.limit(5), f"{tmp_path}/relax")
    sinks.append_poses(poses.limit(3), f"{tmp_path}/relax")
    tables = store.PoseStore(spark, str(tmp_path))
    assert tables.ids().count() == 60 and tables.poses("0007").count() == 30
    assert "lines" not in tables.poses().columns and "lines" in tables.poses(structure=True).columns
    assert tables.relax_poses().count() == 8
    lead = store.load_full_table(spark, f"{tmp_path}/docking")
    assert lead.count() == len(pose_table)


def test_store_skips_and_reports_unreadable_files(spark, pose_table, tmp_path):
    poses = spark.createDataFrame(pose_table)
    poses.repartition(6, "pdb").write.partitionBy("dataset").parquet(f"{tmp_path}/docking")
    poses.limit(3).write.partitionBy("dataset").parquet(f"{tmp_path}/relax")
    poses.limit(0).write.parquet(f"{tmp_path}/docking/dataset=none")
    cut = sorted((tmp_path / "docking").rglob("*.parquet"), key=lambda p: p.stat().st_size)[-1]
    lost = {r["pdb"] for r in spark.read.parquet(str(cut)).select("pdb").distinct().collect()}
    cut.write_bytes(cut.read_bytes()[:-40])
    (cut.parent / f".{cut.name}.crc").unlink(missing_ok=True)
    (tmp_path / "docking" / "dataset=main" / "part-none.parquet").write_bytes(b"PAR1")
    with pytest.raises(Exception):
        store.PoseStore(spark, str(tmp_path)).poses().select("pdb", "row_idx").collect()
    tables = store.PoseStore(spark, str(tmp_path), skip_unreadable=True)
    rest = pose_table[~pose_table["pdb"].isin(lost)]
    assert tables.poses().count() == len(rest) and 0 < len(rest) < len(pose_table)
    reports = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in tables.unreadable().collect()}
    assert reports == {cut.name: "no footer at its end", "part-none.parquet": "too short"}
    counts = rest.groupby(["pdb", "type"]).size()
    label = counts.index[0][1]
    target = int(counts.xs(label, level="type").iloc[0])
    complete = set(counts.xs(label, level="type").loc[lambda s: s == target].index)
    got = progress.extract_complete(tables.poses(), target, (label,))
    assert {r["pdb"] for r in got.select("pdb").distinct().collect()} == complete


def test_bucketed_tables_need_no_exchange_per_complex(spark, pose_table, tmp_path):
    rows_ = spark.createDataFrame(pose_table)
    one = bucketed.write_bucketed(rows_, f"{tmp_path}/a", 8)
    two = bucketed.write_bucketed(rows_.limit(50), f"{tmp_path}/b", 8)
    affinity = spark.createDataFrame([(p, 1.0) for p in pose_table["pdb"].unique()], "pdb string, log_kd double")
    plans = [
        aggregate.lowest_pose(one, ["pdb"], "idelta_score"),
        one.groupBy("pdb").agg(F.min("total_score")).join(two.groupBy("pdb").agg(F.max("total_score")), "pdb", "full"),
        progress.progress_of_counts(progress.label_counts(one)),
    ]
    for df in plans:
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and "Bucketed: true" in text
    kind = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(kind)
    spark.conf.set(kind, -1)
    joined = aggregate.join_affinity(one, affinity).groupBy("pdb").count()
    text = joined._jdf.queryExecution().executedPlan().toString()
    spark.conf.set(kind, before)
    # Only the affinity side moves.
    assert "Bucketed: true" in text
    assert all("total_score" not in line and "row_idx" not in line for line in text.splitlines() if "Exchange" in line)
    assert joined.agg(F.sum("count")).first()[0] == len(pose_table)
    spark.sql(f"DROP TABLE {bucketed._name(f'{tmp_path}/a', 8)}")
    again = bucketed.open_bucketed(spark, f"{tmp_path}/a", 8)
    assert again.count() == len(pose_table)
    assert "Exchange" not in again.groupBy("pdb").count()._jdf.queryExecution().executedPlan().toString()


def test_counts_follow_batches_and_replays(spark, pose_table, tmp_path):
    table, counts = f"{tmp_path}/table", f"{tmp_path}/counts"
    rows_ = spark.createDataFrame(pose_table)
    assert ingest.read_counts(spark, counts).count() == 0
    parts = rows_.randomSplit([1.0, 1.0, 1.0], seed=1)
    parts = [spark.createDataFrame(p.collect(), rows_.schema) for p in parts]
    for number in (0, 1, 2, 1):
        ingest.record_batch(parts[number], number, table, counts)
    whole = progress.label_counts(spark.read.parquet(table))
    keys = ["dataset", "pdb", "type", "n"]
    assert rows(ingest.total_counts(spark, counts).select(*keys)) == rows(whole.select(*keys))
    assert whole.agg(F.sum("n")).first()[0] == len(pose_table)
    work, targets = rows_.select("pdb").distinct(), {label: 40 for label in pose_table["type"].unique()}
    want = rows(progress.resume_plan(work, rows_, targets))
    assert rows(progress.resume_plan_of_counts(work, ingest.read_counts(spark, counts), targets)) == want


def test_counted_stream_resumes(spark, tmp_path):
    schema = T.StructType([f for f in pose_schema().fields if f.name in ("dataset", "pdb", "type", "row_idx")])
    landing, table, counts, state = (str(tmp_path / n) for n in ("landing", "table", "counts", "state"))
    for start in (0, 10):
        data = [("main", f"{i % 3}abc", "relax", i) for i in range(start, start + 10)]
        spark.createDataFrame(data, schema).write.mode("append").parquet(landing)
        ingest.append_counted(spark, landing, schema, table, counts, state).awaitTermination()
        totals = {r["pdb"]: r["n"] for r in ingest.total_counts(spark, counts).collect()}
        assert totals == {f"{k}abc": sum(i % 3 == k for i in range(start + 10)) for k in range(3)}


def test_subset_keeps_rows_of_missing_and_repeated_numbers(spark):
    label = "relax_docking_perturb"
    data = [("a", label, n, -1.0, s, k) for k, (n, s) in enumerate([(None, -1.0), (1, -1.0), (1, 1.0), (1, -2.0), (2, -3.0)])]
    data += [("b", label, 1, -1.0, -1.0, 9), ("a", "relax_docking_std", 1, -1.0, -1.0, 8), ("a", label, 3, None, -1.0, 7)]
    poses = spark.createDataFrame(data, "pdb string, type string, row_idx long, total_score double, idelta_score double, k int")
    affinity = spark.createDataFrame([("a", 5.0), ("a", 4.0)], "pdb string, log_kd double")
    got = store.filtered_subset(poses, affinity)
    assert got.columns == [*poses.columns, "log_kd", "type_seq_id"]
    found = sorted((r["k"], r["log_kd"]) for r in got.collect())
    assert found == [(0, 4.0), (1, 4.0), (3, 4.0), (4, 4.0)]
    ids = {r["k"]: r["type_seq_id"] for r in got.collect()}
    assert ids[0] == 0 and ids[4] == 4 and {ids[1], ids[3]} < {1, 2, 3}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 2


def test_ingest_resumes_without_repeats(spark, tmp_path):
    fields = [f for f in pose_schema().fields if f.name in ("dataset", "pdb", "type", "row_idx", "total_score")]
    schema = T.StructType(fields)
    landing, table, state = (str(tmp_path / n) for n in ("landing", "table", "state"))

    def land(first):
        data = [("main", "1abc", "relax", i, float("nan") if i % 5 == 0 else -1.0) for i in range(first, first + 10)]
        spark.createDataFrame(data, schema).write.mode("append").parquet(landing)

    for start, total in ((0, 10), (10, 20), (None, 20)):
        if start is not None:
            land(start)
        append_new_files(spark, landing, schema, table, state).awaitTermination()
        got = spark.read.parquet(table)
        assert got.count() == total == got.select("row_idx").distinct().count()
    assert got.where("total_score is null").count() == 4


def test_pose_schema_width():
    assert len(pose_schema()) == 4 + 57


def test_feature_reports_and_refit(spark):
    rng = np.random.default_rng(31)
    n = 400
    table = pd.DataFrame(rng.normal(-1, 1, (n, 25)), columns=[f"relax_idelta_{t}" for t in FEATURE_TERMS])
    table["relax_idelta_score"] = table.sum(axis=1)
    table["dG"] = -(0.8 * table["relax_idelta_fa_atr"] + 0.3 * table["relax_idelta_fa_sol"])
    table = table.assign(
        pdb=[str(i) for i in range(n)], split_a=np.where(np.arange(n) % 10 < 7, "train", np.where(np.arange(n) % 10 < 8, "val", "test")),
        affinity_type="Kd", vague_measures=np.arange(n) % 20 == 0, covalent=False, fully_relaxed=True, qed=0.5,
        has_rare_element=False, rmsd_relax_to_crystal=1.0, crystal_idelta_score=table["relax_idelta_score"] - 1,
        relax_total_score=-5.0 + rng.normal(size=n), ligaway_total_score=-4.0, crystal_total_score=-3.0,
    )
    df = spark.createDataFrame(table)
    got = feature_report.feature_report(df, ["split_a"], "split_a")
    assert got.waterfall.orderBy("step").collect()[-1]["remaining"] == n - 20
    assert got.split_sizes.first()["train"] == int(280 * 0.9) and got.overlap.count() == 64
    assert got.metrics.count() == 3 and got.heatmap.agg(F.sum("n")).first()[0] > 0
    assert got.boxes.count() == 20
    fit = feature_report.refit_energies(df, "split_a", epochs=2500, lr=0.05)
    weights = {r["energy_term"]: r["weight"] for r in fit.weights.collect()}
    assert len(weights) == 20 and min(weights.values()) > 0
    assert weights["relax_idelta_fa_atr"] > 0.6 > weights["relax_idelta_fa_rep"] + 0.4
    assert {r["part"]: r["mae"] for r in fit.metrics.collect()}["test"] < 0.3


def test_all_bad_flags_are_tallied(spark):
    index = spark.createDataFrame(
        [("a", "2.0", ["covalent", "NMR, redundant"]), ("b", "2.0", ["pH 7"])],
        "pdb string, resolution string, flags array<string>",
    )
    assert rows(annotations.all_removal_flags(index)) == [("NMR", 1), ("covalent", 1), ("redundant", 1)]
    assert rows(annotations.with_removal_reason(index).select("pdb", "reason")) == [("a", "covalent"), ("b", "kept")]


def test_ligand_reasons_in_order(spark):
    data = [("a", 20, False, None), ("b", 5, True, 0.1), ("c", 5, True, 0.5), ("d", 501, False, 0.5), ("e", 9, True, 0.5), ("f", 9, False, 0.5)]
    df = spark.createDataFrame(data, "pdb string, heavy_atoms long, has_rare boolean, qed double")
    got = [r["reason"] for r in annotations.ligand_reason(df).orderBy("pdb").collect()]
    assert got == ["parse", "qed", "heavy atom count", "heavy atom count", "rare element", "kept"]


def test_storage_report(spark):
    df = spark.createDataFrame([("m", "abc", 1.5), ("m", "é", None), ("n", "", 2.0)], "dataset string, t string, f float")
    got = {(r["dataset"], r["column_name"]): (r["bytes"], r["size_text"]) for r in progress.storage_report(df, ["t", "f"]).collect()}
    assert got["m", "t"] == (5, "5.00 B") and got["m", "f"] == (4, "4.00 B") and got["n", "t"] == (0, "0 B")
    assert got["m", "TOTAL"] == (9, "9.00 B") and got["TOTAL", "TOTAL"] == (13, "13.00 B")
