"""Sources and sinks: tables are written as the real formats, then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posequarry import sinks
from posequarry.functions import text
from posequarry.operators import contacts
from posequarry.plans import driver_tables as t
from posequarry.plans.catalog import n_rows, query, r6, with_views, written_once
from posequarry.session import scratch_path
from posequarry.sources import index, splits, store, text_lines
from posequarry.sources.bucketed import open_bucketed, write_bucketed


def pose_store(spark: SparkSession, folder: str, skip_unreadable: bool = False) -> store.PoseStore:
    def build(path: str) -> None:
        sinks.write_clustered(t.poses(spark, folder), f"{path}/docking")
        sinks.write_clustered(t.relax_poses(spark, folder), f"{path}/relax")

    return store.PoseStore(spark, written_once(spark, folder, "store", build), skip_unreadable=skip_unreadable)


# Buckets of the tables here; a larger store takes more.
BUCKETS = 16


def bucketed_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Docking and relax scores bucketed on the complex."""
    columns = ["dataset", "pdb", "type", "row_idx", "total_score", "idelta_score"]

    def build(path: str) -> None:
        write_bucketed(t.poses(spark, folder).select(*columns), f"{path}/docking", BUCKETS)
        write_bucketed(t.relax_poses(spark, folder).select(*columns), f"{path}/relax", BUCKETS)

    path = written_once(spark, folder, "bucketed", build)
    return open_bucketed(spark, f"{path}/docking", BUCKETS), open_bucketed(spark, f"{path}/relax", BUCKETS)


def text_file(spark: SparkSession, folder: str, name: str, lines: DataFrame) -> str:
    return written_once(
        spark, folder, name, lambda path: lines.select(F.col("line").alias("value")).write.text(path)
    )


@query(
    "S1_result_store",
    with_views(t.POSES, t.RELAX, body="""
      SELECT coalesce(d.pdb, r.pdb) AS pdb, n_docking, n_relax, docking_total, relax_total FROM
        (SELECT pdb, count(*) AS n_docking, round(sum(total_score), 6) AS docking_total FROM poses GROUP BY pdb) d
        FULL JOIN (SELECT pdb, count(*) AS n_relax, round(sum(total_score), 6) AS relax_total
          FROM relax_poses GROUP BY pdb) r ON d.pdb = r.pdb"""),
)
def result_store(spark, folder):
    poses, relaxed = bucketed_tables(spark, folder)
    n = F.count(F.lit(1))
    docking = poses.groupBy("pdb").agg(n.alias("n_docking"), r6(F.sum("total_score"), "docking_total"))
    relax = relaxed.groupBy("pdb").agg(n.alias("n_relax"), r6(F.sum("total_score"), "relax_total"))
    return docking.join(relax, "pdb", "full")


@query("S2_store_catalog", with_views(t.POSES, body="SELECT DISTINCT pdb FROM poses"))
def store_catalog(spark, folder):
    return pose_store(spark, folder).ids()


@query(
    "S3_pruned_read",
    with_views(t.POSES, body="""SELECT dataset, count(*) AS n, round(sum(idelta_score), 6) AS idelta
      FROM poses GROUP BY dataset"""),
)
def pruned_read(spark, folder):
    rows = pose_store(spark, folder).poses().select("dataset", "idelta_score")
    return rows.groupBy("dataset").agg(n_rows("n"), r6(F.sum("idelta_score"), "idelta"))


@query(
    "S4_affinity_index",
    with_views(t.INDEX_LINES, body=r"""SELECT pdb, kd_M, round(log10(kd_M), 6) AS log_kd FROM (
      SELECT lower(f[1]) AS pdb, regexp_extract(f[4], '^Kd=([0-9]+)', 1)::DOUBLE *
        CASE regexp_extract(f[4], '[a-z]?M$') WHEN 'mM' THEN 1e-3 WHEN 'uM' THEN 1e-6 WHEN 'nM' THEN 1e-9
          WHEN 'pM' THEN 1e-12 WHEN 'fM' THEN 1e-15 ELSE 1.0::DOUBLE END AS kd_M
      FROM (SELECT regexp_split_to_array(line, '\s+') AS f FROM index_lines WHERE line NOT LIKE '#%')
      WHERE regexp_matches(f[4], '^Kd=[0-9]+[munpf]?M$'))"""),
)
def affinity_index(spark, folder):
    path = text_file(spark, folder, "index", t.index_lines(spark, folder))
    return index.load_kd_index(spark, path).select("pdb", "kd_M", r6("log_kd", "log_kd"))


@query(
    "S5_annotation_index",
    with_views(t.ANNOTATIONS, body="""SELECT pdb, resolution, affinity_raw, ligand,
      array_to_string(flags, '|') AS flags FROM annotations"""),
)
def annotation_index(spark, folder):
    path = text_file(spark, folder, "index", t.index_lines(spark, folder))
    return index.load_annotations(spark, path).withColumn("flags", F.array_join("flags", "|"))


@query(
    "S6_affinity_csv",
    with_views(t.MEASURES, body="""SELECT pdb, CASE WHEN p_size > 25 THEN 'train' ELSE 'test' END AS new_split,
      measure AS "kd/ki", p_partkey % 3 = 0 AS covalent FROM measures"""),
)
def affinity_csv(spark, folder):
    rows = t.measures(spark, folder).select(
        "pdb",
        F.when(F.col("p_size") > 25, "train").otherwise("test").alias("new_split"),
        F.col("measure").alias("kd/ki"),
        (F.col("p_partkey") % 3 == 0).alias("covalent"),
    )
    path = written_once(spark, folder, "affinity_csv", lambda p: rows.write.csv(p, header=True))
    return index.load_affinity_csv(spark, path)


@query(
    "S7_json_lists",
    """SELECT list_name, pdb, count(*) AS n FROM (
      SELECT 'train' AS list_name, user_id::VARCHAR AS pdb FROM events
      UNION ALL SELECT 'train', event_id::VARCHAR FROM events
      UNION ALL SELECT 'test_a', (event_id + user_id)::VARCHAR FROM events) GROUP BY ALL""",
)
def json_lists(spark, folder):
    document = F.format_string(
        '{"train": ["%d", "%d"], "test_a": ["%d"]}',
        "user_id",
        "event_id",
        F.col("event_id") + F.col("user_id"),
    )
    documents = t.read(spark, folder, "events").select(document.alias("value"))
    return splits.parse_json_lists(documents).groupBy("list_name", "pdb").agg(n_rows("n"))


@query(
    "S8_id_list",
    """SELECT pdb, count(*) AS n FROM (SELECT c_custkey::VARCHAR AS pdb FROM customer
      UNION ALL SELECT 'n' || c_nationkey::VARCHAR FROM customer) GROUP BY pdb""",
)
def id_list(spark, folder):
    line = F.format_string(" %d , n%d,", "c_custkey", "c_nationkey").alias("line")
    path = text_file(spark, folder, "id_list", t.read(spark, folder, "customer").select(line))
    return splits.load_id_list(spark, path).groupBy("pdb").agg(n_rows("n"))


@query(
    "S9_external_split_index",
    """SELECT user_id, event_type FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1""",
)
def external_split_index(spark, folder):
    rows = t.read(spark, folder, "events").select("user_id", "event_type", "event_id")
    return splits.first_split(rows, "user_id", [F.col("event_id")]).select("user_id", "event_type")


@query(
    "S10_weights_json",
    r"""SELECT regexp_extract(props, '"([^"]+)"', 1) AS term, count(*) AS n,
      round(sum(regexp_extract(props, ': *([0-9.]+)', 1)::DOUBLE), 6) AS weight FROM events GROUP BY 1""",
)
def weights_json(spark, folder):
    weights = store.parse_weights(t.read(spark, folder, "events").select("props"), "props")
    return weights.groupBy("term").agg(n_rows("n"), r6(F.sum("weight"), "weight"))


@query(
    "S11_structure_lines",
    with_views(t.ATOMS, body="""SELECT pdb, line_no, record, atom_no, atom_name, residue, chain, res_no,
      x, y, z, element FROM atoms"""),
)
def structure_lines(spark, folder):
    return contacts.parsed_atoms(t.structure_lines(spark, folder))


def ligand_file_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Ligand file text from ``lineitem``: atom, bond and other lines."""
    k = F.col("l_linenumber")
    element = F.when(F.col("l_partkey") % 40 == 0, "H").otherwise("C")
    atom = F.format_string(
        "%10.4f%10.4f%10.4f %-3s 0  0  0  0  0  0",
        F.col("l_quantity"),
        F.col("l_discount"),
        F.col("l_tax"),
        element,
    )
    wide = F.concat(atom, F.lit("  0  0  0  0  0  0"))
    order = F.when(F.col("l_orderkey") % 50 == 0, 4).otherwise(1)
    bond = F.format_string("%3d%3d%3d  0  0  0", k, k + 1, order)
    line = F.when(k <= 3, wide).when(k == 4, atom).when(k <= 6, bond).otherwise("M  END")
    return t.read(spark, folder, "lineitem").select(
        t.pdb_id(F.col("l_suppkey")).alias("pdb"), line.alias("line")
    )


@query(
    "S12_ligand_atoms",
    """SELECT printf('%04d', l_suppkey) AS pdb, l_quantity AS x, l_discount AS y, l_tax AS z
      FROM lineitem WHERE l_linenumber <= 4""",
)
def ligand_atoms(spark, folder):
    return index.ligand_atoms(ligand_file_lines(spark, folder))


PROBE = """probe AS (SELECT printf('%04d', l_suppkey) AS pdb,
  bool_or(l_linenumber <= 4 AND l_partkey % 40 = 0) AS has_hydrogen,
  bool_or(l_linenumber IN (5, 6) AND l_orderkey % 50 = 0) AS has_aromatic FROM lineitem GROUP BY 1)"""


@query("S13_ligand_probe", with_views(PROBE, body="SELECT * FROM probe"))
def ligand_probe(spark, folder):
    return index.ligand_probe(ligand_file_lines(spark, folder))


@query(
    "S14_nth_line",
    with_views(t.LOG_LINES, body="SELECT job AS path, line FROM log_lines WHERE line_no = 3 AND line LIKE '%the%'"),
)
def nth_line(spark, folder):
    numbered = t.log_lines(spark, folder).withColumnRenamed("job", "path")
    return text_lines.nth_line_contains(numbered, 3, "the")


@query(
    "S15_log_folder",
    with_views(t.LOG_LINES, body="""SELECT string_split(job, '_')[1] AS job, count(*) AS n_lines,
      count(*) FILTER (WHERE line LIKE '%tion%') AS n_hits FROM log_lines GROUP BY 1"""),
)
def log_folder(spark, folder):
    lines = t.log_lines(spark, folder)
    rows = lines.select(
        F.substring_index("job", "_", 1).alias("source"), "job", "line_no", F.col("line").alias("value")
    )
    path = written_once(
        spark,
        folder,
        "logs",
        lambda p: rows.repartitionByRange("source", "job", "line_no")
        .sortWithinPartitions("source", "job", "line_no")
        .select("source", "value")
        .write.partitionBy("source")
        .text(p),
    )
    read = text_lines.read_logs(spark, path, job_pattern="source=([^/]+)/")
    return read.groupBy("job").agg(
        n_rows("n_lines"), F.count_if(F.col("line").contains("tion")).alias("n_hits")
    )


@query(
    "S16_work_list",
    """SELECT CASE WHEN c_custkey % 4 = 1 THEN printf('%04d_LIG', c_custkey % 10000)
      ELSE printf('%04d', c_custkey % 10000) END AS pdb, count(*) AS n
      FROM customer WHERE c_custkey % 4 <> 0 GROUP BY 1""",
)
def work_list(spark, folder):
    k = F.col("c_custkey")
    short = F.format_string("%04d", k % 10000)
    line = (
        F.when(k % 4 == 0, F.concat(F.lit("# "), short))
        .when(k % 4 == 1, F.concat(short, F.lit("_LIG")))
        .otherwise(F.concat(short, F.lit(";A,B;")))
    )
    path = text_file(spark, folder, "work", t.read(spark, folder, "customer").select(line.alias("line")))
    return index.load_work_list(spark, path).groupBy("pdb").agg(n_rows("n"))


def cleaned_index_rows(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    empty = F.array().cast("array<string>")
    return t.read(spark, folder, "part").select(
        t.pdb_id(k).alias("pdb"),
        F.when(k % 3 == 0, F.array(F.lit("A"))).otherwise(F.array(F.lit("A"), F.lit("B"))).alias("chains"),
        F.when(k % 5 == 0, F.array(F.format_string(" ZN:%d", "p_size"), F.lit(" MG:7")))
        .otherwise(empty)
        .alias("cofactors"),
    )


CLEANED = """cleaned AS (SELECT printf('%04d', p_partkey) AS pdb,
  CASE WHEN p_partkey % 3 = 0 THEN 'A' ELSE 'A|B' END AS chains,
  CASE WHEN p_partkey % 5 = 0 THEN printf(' ZN:%d', p_size) || '| MG:7' ELSE '' END AS cofactors FROM part)"""


def joined_lists(rows: DataFrame) -> DataFrame:
    return rows.select("pdb", F.array_join("chains", "|").alias("chains"), F.array_join("cofactors", "|").alias("cofactors"))


@query("S17_cleaned_index", with_views(CLEANED, body="SELECT * FROM cleaned"))
def cleaned_index(spark, folder):
    rows = cleaned_index_rows(spark, folder)
    path = written_once(spark, folder, "cleaned", lambda p: sinks.write_index(rows, p))
    return joined_lists(index.load_cleaned_index(spark, path))


@query(
    "S18_full_table",
    with_views(t.POSES, body="""SELECT type, count(*) AS n, count(raw_delta_hbond_sc) AS n_present,
      round(sum(raw_delta_hbond_sc), 6) AS total FROM poses GROUP BY type"""),
)
def full_table(spark, folder):
    rows = store.load_full_table(spark, f"{pose_store(spark, folder).folder}/docking")
    return rows.groupBy("type").agg(
        n_rows("n"),
        F.count("raw_delta_hbond_sc").alias("n_present"),
        r6(F.sum("raw_delta_hbond_sc"), "total"),
    )


SUBSET = """subset AS (
  SELECT p.*, a.log_kd FROM (
    SELECT *, row_number() OVER (PARTITION BY pdb, type ORDER BY row_idx) - 1 AS type_seq_id FROM poses) p
  JOIN affinity a USING (pdb)
  WHERE p.type IN ('relax_docking_perturb', 'apo_relax_docking_perturb')
    AND total_score <= 0 AND idelta_score <= 0)"""


@query(
    "S19_filtered_subset",
    with_views(t.POSES, t.AFFINITY, SUBSET, body="""SELECT pdb, type, row_idx, type_seq_id,
      round(log_kd, 6) AS log_kd FROM subset"""),
)
def filtered_subset(spark, folder):
    path = scratch_path(spark, "subset")
    rows = store.load_filtered(spark, path, t.poses(spark, folder), t.affinity(spark, folder))
    return rows.select("pdb", "type", "row_idx", "type_seq_id", r6("log_kd", "log_kd"))


@query(
    "S20_extract_complete",
    with_views(t.POSES, body="""SELECT pdb, type, row_idx, round(idelta_score, 6) AS idelta_score FROM poses
      WHERE pdb IN (SELECT pdb FROM poses GROUP BY pdb
        HAVING count(*) FILTER (WHERE type = 'apo_relax_docking_std') = 100)"""),
)
def extract_complete(spark, folder):
    rows = pose_store(spark, folder, skip_unreadable=True).extract(target=100)
    return rows.select("pdb", "type", "row_idx", r6("idelta_score", "idelta_score"))


@query(
    "K1_append_poses",
    with_views(t.POSES, body="SELECT dataset, type, count(*) AS n, count(DISTINCT row_idx) AS n_rows FROM poses GROUP BY ALL"),
)
def append_poses(spark, folder):
    path, rows = scratch_path(spark, "appended"), t.poses(spark, folder)
    sinks.append_poses(rows.where(F.col("type").endswith("perturb")), path)
    table = sinks.append_poses(rows.where(~F.col("type").endswith("perturb")), path)
    return table.groupBy("dataset", "type").agg(
        n_rows("n"), F.count_distinct("row_idx").alias("n_rows")
    )


@query(
    "K2_append_relax",
    with_views(t.RELAX, body="""SELECT dataset, type, count(*) AS n, round(sum(total_score), 6) AS total
      FROM relax_poses GROUP BY ALL"""),
)
def append_relax(spark, folder):
    table = sinks.append_poses(t.relax_poses(spark, folder), scratch_path(spark, "relax"))
    return table.groupBy("dataset", "type").agg(
        n_rows("n"), r6(F.sum("total_score"), "total")
    )


@query(
    "K3_write_subset",
    with_views(t.POSES, t.AFFINITY, SUBSET, body="SELECT pdb, count(*) AS n, sum(type_seq_id)::BIGINT AS seq FROM subset GROUP BY pdb"),
)
def write_subset(spark, folder):
    rows = store.filtered_subset(t.poses(spark, folder), t.affinity(spark, folder))
    table = sinks.write_table(rows, scratch_path(spark, "subset"))
    return table.groupBy("pdb").agg(n_rows("n"), F.sum("type_seq_id").alias("seq"))


@query(
    "K4_report_csv",
    with_views(t.POSES, body="""SELECT pdb, type, count(*) AS n, round(min(idelta_score), 6) AS best
      FROM poses GROUP BY ALL"""),
)
def report_csv(spark, folder):
    report = t.poses(spark, folder).groupBy("pdb", "type").agg(
        n_rows("n"), r6(F.min("idelta_score"), "best")
    )
    return sinks.write_report_csv(report, scratch_path(spark, "report"))


@query("K5_write_index", with_views(CLEANED, body="SELECT * FROM cleaned"))
def write_index(spark, folder):
    return joined_lists(sinks.write_index(cleaned_index_rows(spark, folder), scratch_path(spark, "index")))


@query(
    "K6_write_structures",
    with_views(t.ATOMS, body="""SELECT pdb, row_number() OVER (PARTITION BY pdb ORDER BY line_no) - 1 AS position,
      CASE WHEN record = 'TER' THEN NULL ELSE atom_no END AS atom_no FROM all_lines"""),
)
def write_structures(spark, folder):
    path = sinks.write_structures(t.structure_lines(spark, folder), scratch_path(spark, "structures"))
    lines = text_lines.read_lines(spark, path)
    pdb = F.regexp_extract("path", "pdb=([^/]+)/", 1)
    numbered = text_lines.number_lines(lines, pdb)
    number = F.trim(F.substring("line", 7, 5)).try_cast("int")
    return numbered.select(pdb.alias("pdb"), F.col("line_no").alias("position"), number.alias("atom_no"))


@query(
    "K7_delete_from_index",
    with_views(CLEANED, body="""SELECT * FROM cleaned WHERE pdb NOT IN (
      SELECT printf('%04d', s_suppkey) FROM supplier WHERE s_acctbal >= 0)"""),
)
def delete_from_index(spark, folder):
    rows = cleaned_index_rows(spark, folder)
    path = written_once(spark, folder, "cleaned", lambda p: sinks.write_index(rows, p))
    suppliers = t.read(spark, folder, "supplier").select(t.pdb_id(F.col("s_suppkey")).alias("pdb"), "s_acctbal")
    keep = suppliers.where("s_acctbal < 0")
    return joined_lists(
        sinks.delete_from_index(spark, path, scratch_path(spark, "index"), suppliers, keep)
    )


@query(
    "K8_cluster_cache",
    with_views(t.CLUSTERS, body="SELECT pdb, row_idx, cluster_id, is_rep, round(rmsd, 6) AS rmsd FROM members"),
)
def cluster_cache(spark, folder):
    poses = t.coordinates(spark, folder)
    cache = scratch_path(spark, "clusters")
    sinks.cached_clusters(poses, 0.3, cache)
    return sinks.cached_clusters(poses, 0.3, cache).withColumn("rmsd", F.round("rmsd", 6))


@query(
    "K9_rename_ligand_chain",
    with_views(t.ATOMS, body="""SELECT pdb, CASE WHEN record = 'HETATM' AND residue = 'UNK' THEN 'X' ELSE chain END AS chain,
      count(*) AS n FROM atoms GROUP BY ALL"""),
)
def rename_ligand_chain(spark, folder):
    lines = t.structure_lines(spark, folder).withColumn("line", text.rename_ligand_chain(F.col("line"), "X"))
    return contacts.parsed_atoms(lines).groupBy("pdb", "chain").agg(n_rows("n"))
