"""Text formats and parsers on hand-written rows."""

import math

import pytest
from pyspark.sql import functions as F

from posequarry import sinks
from posequarry.functions import affinity as aff
from posequarry.functions import delta, text
from posequarry.operators import annotations, features, logs
from posequarry.sources import index, splits, store, text_lines
from tests.conftest import rows

INDEX = """# comment line
1ABC  1.90  2001  Kd=12.5uM   // 1abc.pdf (XYZ) covalent complex; pH 7
2def  NMR   1999  Ki<=3nM     // 2def.pdf (4-mer)

3ghi  2.75  2010  Kd~4mM      // 3ghi.pdf (ABC)
4jkl  2.00  2015  Kd=3nM      // 4jkl.pdf (DEF) Incomplete ligand; isomer
5mno  2.00  2015  Kd=7M//x    // 5mno.pdf (DEF) odd note, pH 7
6pqr  2.00
"""


@pytest.fixture()
def index_path(tmp_path):
    path = tmp_path / "index.lst"
    path.write_text(INDEX)
    return str(path)


def test_kd_index(spark, index_path):
    got = {r["pdb"]: (r["kd_M"], r["log_kd"]) for r in index.load_kd_index(spark, index_path).collect()}
    assert set(got) == {"1abc", "4jkl", "5mno"}
    assert got["1abc"][0] == pytest.approx(1.25e-5) and got["4jkl"][0] == pytest.approx(3e-9)
    assert got["1abc"][1] == pytest.approx(math.log10(1.25e-5))


def test_annotations_and_reasons(spark, index_path):
    parsed = index.load_annotations(spark, index_path)
    got = {r["pdb"]: r for r in annotations.with_removal_reason(parsed).collect()}
    assert got["1ABC"]["flags"] == ["covalent complex", " pH 7"] and got["1ABC"]["reason"] == "covalent"
    assert got["2def"]["ligand"] == "4-mer" and got["2def"]["flags"] == ["peptide (xmer)"]
    assert got["2def"]["reason"] == "peptide (xmer)"
    assert got["3ghi"]["reason"] == "resolution" and got["4jkl"]["reason"] == "incomplete ligand"
    assert got["6pqr"]["reason"] == "kept"
    tally = annotations.unknown_flag_tally(parsed.where("pdb in ('1ABC', '4jkl')"))
    assert rows(tally) == [("incomplete ligand", 1)]


@pytest.mark.parametrize(
    ("measure", "value", "unit"),
    [
        ("Kd=12.5uM", 12.5, "uM"),
        ("Kd=3nM//x", 3.0, "nM"),
        ("Kd=2M", 2.0, "M"),
        ("Kd=1e-5M", None, None),
        ("Kd=5MM", None, None),
        ("xKd=3nM", None, None),
        ("Kd<=3nM", None, None),
        ("Ki=3nM", None, None),
        (None, None, None),
    ],
)
def test_exact_kd(spark, measure, value, unit):
    df = spark.createDataFrame([(measure,)], "m string")
    assert df.select(aff.exact_kd_value(F.col("m")), aff.exact_kd_unit(F.col("m"))).first() == (value, unit)


@pytest.mark.parametrize(
    ("measure", "kind", "value", "unit", "vague", "molar"),
    [
        ("Ki>=5nM", "Ki", 5.0, "nM", True, 5e-9),
        ("IC50=2.5uM", "IC50", 2.5, "uM", False, 2.5e-6),
        ("Kd~4mM", "Kd", 4.0, "mM", True, 4e-3),
        ("Kd<4fM", "Kd", 4.0, "fM", True, 4e-15),
        ("Kd=4XM", "Kd", 4.0, "XM", False, 4e-18),
    ],
)
def test_general_measure(spark, measure, kind, value, unit, vague, molar):
    df = spark.createDataFrame([(measure,)], "m string").select(aff.measure_parts(F.col("m")).alias("p"))
    assert df.select("p.*").first() == (kind, value, unit, vague)
    got = df.select(aff.ladder_molar(F.col("p.value"), F.col("p.unit")).alias("v"))
    assert got.first()["v"] == pytest.approx(molar)
    energy = got.select(aff.free_energy(F.col("v"))).first()[0]
    assert energy == pytest.approx(-1.987 * 298.15 * math.log(molar) / 1000)


def test_bad_units_are_reported(spark):
    table = spark.createDataFrame([("a", "Kd=4XM"), ("b", "Kd=4nM")], "pdb string, `kd/ki` string")
    assert rows(features.bad_units(table)) == [("a", "Kd=4XM", "XM")]


STRUCTURE = """ATOM      1  N   ALA A   1      11.104   6.134  -6.504  1.00  0.00           N
ATOM      2  H   ALA A   1      11.700   6.200  -6.100  1.00  0.00           H
TER
HETATM    3  SE  MSE A   2      12.000   6.000  -6.000  1.00  0.00          SE
TER
HETATM    4 ZN    ZN A 301      13.000   6.000  -6.000  1.00  0.00          ZN
"""


def test_structure_lines(spark, tmp_path):
    (tmp_path / "1abc_protein.pdb").write_text(STRUCTURE)
    lines = index.load_structure_lines(spark, str(tmp_path))
    assert rows(lines.select("pdb", "line_no"))[0] == ("1abc", 0)
    assert [r["line"] for r in lines.orderBy("line_no").collect()] == STRUCTURE.splitlines()
    from posequarry.operators.contacts import parsed_atoms, with_ter_blocks

    atoms = parsed_atoms(with_ter_blocks(lines)).orderBy("line_no").collect()
    assert [a["ter_block"] for a in atoms] == [0, 0, 1, 2]
    first, last = atoms[0], atoms[-1]
    assert (first["record"], first["atom_no"], first["atom_name"], first["residue"]) == ("ATOM", 1, " N  ", "ALA")
    assert (first["chain"], first["res_no"], first["x"], first["z"]) == ("A", 1, 11.104, -6.504)
    assert (last["record"], last["residue"], last["element"], last["res_no"]) == ("HETATM", " ZN", "ZN", 301)


def test_line_numbers_across_splits(spark, tmp_path):
    """A file cut into many splits keeps its line order."""
    path = tmp_path / "long.txt"
    path.write_text("".join(f"line {i}\n" for i in range(20000)))
    saved = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = text_lines.read_lines(spark, str(path))
        assert lines.rdd.getNumPartitions() > 8
        got = text_lines.number_lines(lines).select("line_no", "line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", saved)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r["line_no"], r["line"]) for r in got) == [(i, f"line {i}") for i in range(20000)]


def test_ligand_lines(spark):
    lines = [
        ("a", "   11.1040    6.1340   -6.5040 C   0  0  0  0  0  0"),
        ("a", "    1.0000    2.0000    3.0000 H   0  0  0  0  0  0  0  0  0  0  0  0"),
        ("a", "  1  2  4  0  0  0"),
        ("b", "    1.0000    2.0000    3.0000 C   0  0  0  0  0  0  0  0  0  0  0  0"),
        ("b", "  1  2  1  0  0  0"),
        ("b", "M  END"),
    ]
    df = spark.createDataFrame(lines, "pdb string, line string")
    assert rows(index.ligand_atoms(df)) == [
        ("a", 1.0, 2.0, 3.0),
        ("a", 11.104, 6.134, -6.504),
        ("b", 1.0, 2.0, 3.0),
    ]
    assert rows(index.ligand_probe(df)) == [("a", True, True), ("b", False, False)]


def test_work_list_picks_the_nth_item(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text("#skip\n10gs;A;ZN:1\n1G9V_RQ3\n#skip\n3abc extra\n")
    assert rows(index.load_work_list(spark, str(path))) == [(0, "10gs"), (1, "1G9V_RQ3"), (2, "3abc")]
    assert index.work_item(spark, str(path), 1).first()["pdb"] == "1G9V_RQ3"


def test_split_sources(spark, tmp_path):
    (tmp_path / "s.json").write_text('{\n "train": ["1abc", "2def"],\n "casf_a": ["3ghi"]\n}')
    lists = splits.load_json_lists(spark, str(tmp_path / "s.json"))
    assert rows(lists) == [("casf_a", "3ghi"), ("train", "1abc"), ("train", "2def")]
    member = splits.membership_of_lists(lists, "s", {"train": ("train", 1), "casf_a": ("test", 2)})
    assert rows(member) == [("s", "1abc", "train", 1), ("s", "2def", "train", 1), ("s", "3ghi", "test", 2)]
    (tmp_path / "ids.md").write_text("1abc, 2def ,3ghi\n4jkl")
    assert rows(splits.load_id_list(spark, str(tmp_path / "ids.md"))) == [("1abc",), ("2def",), ("3ghi",), ("4jkl",)]


def test_split_index_has_one_row_per_id(spark, tmp_path):
    data = [("1abc", "train", 1), ("1abc", "val", 2), ("2def", "test", 3)]
    df = spark.createDataFrame(data, "entry_pdb_id string, split string, other int")
    df.write.parquet(str(tmp_path / "index"))
    index_rows = splits.load_split_index(spark, str(tmp_path / "index"))
    assert rows(index_rows) == [("1abc", "train"), ("2def", "test")]
    plan = index_rows._jdf.queryExecution().executedPlan().toString()
    assert "other" not in plan


def test_weights_file_with_a_huge_number(spark, tmp_path):
    (tmp_path / "w.json").write_text('{\n "???": 4.914646529436531e+252,\n "fa_atr": 0.8\n}')
    assert rows(store.load_weights(spark, str(tmp_path / "w.json"))) == [("???", 4.914646529436531e252), ("fa_atr", 0.8)]


def test_index_round_trip_and_delete(spark, tmp_path):
    data = [("1abc", ["A", "B"], ["ZN:3"]), ("2def", ["C"], []), ("3ghi", [], [])]
    df = spark.createDataFrame(data, "pdb string, chains array<string>, cofactors array<string>")
    path = str(tmp_path / "index")
    assert rows(sinks.write_index(df, path)) == data
    remove = spark.createDataFrame([("1abc",), ("2def",)], "pdb string")
    keep = spark.createDataFrame([("2def",)], "pdb string")
    assert rows(sinks.delete_from_index(spark, path, str(tmp_path / "new"), remove, keep)) == data[1:]


def test_log_rules(spark, tmp_path):
    (tmp_path / "FamA_1_2.err").write_text("start\nIndexError: x\nUnrecognized residue: q\n")
    (tmp_path / "FamA_1_3.err").write_text("nothing\n")
    (tmp_path / "FamB_7_1.err").write_text("Bus error\n")
    lines = text_lines.read_logs(spark, str(tmp_path), "*.err")
    jobs = logs.classify_jobs(lines)
    got = {r["job"]: {c for c in jobs.columns[1:] if r[c]} for r in jobs.collect()}
    assert got == {
        "FamA_1_2": {"index_error", "unrecognized_residue", "engine_error"},
        "FamA_1_3": set(),
        "FamB_7_1": {"oom"},
    }
    classes = ["index_error", "oserror", "engine_error", "oom", "keyerror"]
    totals = logs.class_totals(jobs, classes).first()
    assert (totals["index_error"], totals["oom"], totals["classified"], totals["jobs"]) == (1, 1, 2, 3)
    assert rows(logs.unclassified_jobs(jobs, classes)) == [("FamA_1_3",)]
    assert rows(jobs.select(text.job_family(F.col("job")))) == [("FamA",), ("FamA",), ("FamB",)]


def test_first_match_takes_the_first_line(spark, tmp_path):
    (tmp_path / "A_1.out").write_text("hello\nProcess 7 selected complex 1abc\nProcess 8 selected complex 2def\n")
    (tmp_path / "A_2.out").write_text("hello\n")
    lines = text_lines.read_logs(spark, str(tmp_path), "*.out")
    got = logs.first_match(lines, "selected complex", text_lines.LINE_ORDER)
    assert [tuple(r) for r in got.orderBy("job").collect()] == [("A_1", "1abc"), ("A_2", None)]


@pytest.mark.parametrize(
    ("size", "want"),
    [(0, "0 B"), (1, "1.00 B"), (1023, "1023.00 B"), (1024, "1.00 KB"), (10368, "10.12 KB"),
     (10**6, "976.56 KB"), (5 * 10**9, "4.66 GB"), (3 * 10**13, "27.28 TB")],
)
def test_human_size(spark, size, want):
    df = spark.createDataFrame([(float(size),)], "s double")
    assert df.select(text.human_size(F.col("s"))).first()[0] == want


def test_text_delta_round_trip(spark):
    base, new = ["a", "b", "c", "d"], ["a", "x", "c", ""]
    df = spark.createDataFrame([(base, new)], "base array<string>, new array<string>")
    df = df.withColumn("d", delta.changed_lines(F.col("base"), F.col("new")))
    row = df.select("d", delta.saved_share(F.col("base"), F.col("d")), delta.patched_lines(F.col("base"), F.col("d"))).first()
    assert row[0] == {1: "x", 3: ""} and row[1] == 0.5 and row[2] == new


def test_labels(spark):
    df = spark.createDataFrame(
        [("apo_relax_docking_std",), ("prerelax_docking_perturb",), ("relax_docking_perturb",)], "t string"
    )
    assert rows(df.select(text.start_label(F.col("t")))) == [("apo_relax",), ("prerelax",), ("relax",)]
    assert rows(df.where(text.has_words(F.col("t"), "relax", "perturb"))) == [("relax_docking_perturb",)]


def test_chain_rename(spark):
    lines = [
        ("HETATM    1  C1  UNK A   1      11.104   6.134  -6.504",),
        ("HETATM    1 ZN    ZN A   1      11.104   6.134  -6.504",),
    ]
    df = spark.createDataFrame(lines, "line string").select(text.rename_ligand_chain(F.col("line"), "X"))
    assert [r[0][21] for r in df.collect()] == ["X", "A"]


def test_structure_files_keep_line_order(spark, tmp_path):
    data = [(pdb, i, f"{pdb} line {i}") for pdb in ("1abc", "2def") for i in range(500)]
    lines = spark.createDataFrame(data, "pdb string, line_no long, line string").repartition(7)
    path = sinks.write_structures(lines, str(tmp_path / "out"))
    for pdb in ("1abc", "2def"):
        parts = sorted((tmp_path / "out" / f"pdb={pdb}").glob("part-*"))
        got = "".join(p.read_text() for p in parts).splitlines()
        assert got == [f"{pdb} line {i}" for i in range(500)]
    assert path.endswith("out")
