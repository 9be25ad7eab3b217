"""Views of the benchmark tables in the shape of the pose, index and log tables.

Each view is stated twice: as DataFrame expressions, and as the SQL common
table expression the checks run.  Every view keeps all rows of its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posequarry.session import spread

INFORMATIVE = ("fa_atr", "fa_rep", "fa_sol", "fa_elec", "fa_pair", "hbond_bb_sc", "hbond_sc")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pdb_id(number: Column) -> Column:
    return F.format_string("%04d", number)


# -- poses ---------------------------------------------------------------

DATASET = "CASE WHEN {0} % 10 = 8 THEN 'bench_a' WHEN {0} % 10 = 9 THEN 'bench_b' ELSE 'main' END"


def poses(spark: SparkSession, folder: str) -> DataFrame:
    """Docking rows from ``lineitem``: supplier as complex, flags as run label."""
    rows = spread(read(spark, folder, "lineitem"))
    start = (
        F.when(F.col("l_returnflag") == "A", "crystal")
        .when(F.col("l_returnflag") == "N", "relax")
        .otherwise("apo_relax")
    )
    protocol = F.when(F.col("l_linestatus") == "F", "perturb").otherwise("std")
    quantity, line = F.col("l_quantity"), F.col("l_linenumber")
    part, order = F.col("l_partkey"), F.col("l_orderkey")
    return rows.select(
        F.expr(DATASET.format("l_suppkey")).alias("dataset"),
        pdb_id(F.col("l_suppkey")).alias("pdb"),
        F.concat_ws("_", start, F.lit("docking"), protocol).alias("type"),
        (((order * 8 + line) * 64 + quantity.cast("long")) * 1048576 + part % 1048576).alias("row_idx"),
        (quantity - 25).alias("total_score"),
        (F.col("l_extendedprice") / 997 - 50).alias("idelta_score"),
        (F.col("l_discount") * 20).alias("rmsd_to_crystal"),
        (F.col("l_tax") * 30).alias("rmsd_to_input"),
        (order % 100).cast("double").alias("prepare_time"),
        F.lit(0.0).alias("raw_delta_???"),
        (-quantity / 9.1).alias("raw_delta_fa_atr"),
        (F.col("l_discount") / 0.033).alias("raw_delta_fa_rep"),
        (F.col("l_tax") / 0.0197).alias("raw_delta_fa_sol"),
        F.lit(0.0).alias("raw_delta_rama"),
        ((part % 97) / 9.7 - 5).alias("raw_delta_fa_elec"),
        (-(order % 53) / 19.3).alias("raw_delta_fa_pair"),
        (-line / 4.1).alias("raw_delta_hbond_bb_sc"),
        F.when((line == 7) & (F.col("l_discount") > 0.08), F.lit(None).cast("double"))
        .otherwise(-(part % 13) / 9.9)
        .alias("raw_delta_hbond_sc"),
        F.lit(0.0).alias("raw_delta_ref"),
    )


POSES = f"""poses AS (
  SELECT {DATASET.format('l_suppkey')} AS dataset,
    printf('%04d', l_suppkey) AS pdb,
    CASE l_returnflag WHEN 'A' THEN 'crystal' WHEN 'N' THEN 'relax' ELSE 'apo_relax' END || '_docking_' ||
      CASE l_linestatus WHEN 'F' THEN 'perturb' ELSE 'std' END AS type,
    ((l_orderkey * 8 + l_linenumber) * 64 + l_quantity::BIGINT) * 1048576 + l_partkey % 1048576 AS row_idx,
    l_quantity - 25 AS total_score,
    l_extendedprice / 997 - 50 AS idelta_score,
    l_discount * 20 AS rmsd_to_crystal,
    l_tax * 30 AS rmsd_to_input,
    (l_orderkey % 100)::DOUBLE AS prepare_time,
    0.0::DOUBLE AS "raw_delta_???",
    -l_quantity / 9.1::DOUBLE AS raw_delta_fa_atr,
    l_discount / 0.033::DOUBLE AS raw_delta_fa_rep,
    l_tax / 0.0197::DOUBLE AS raw_delta_fa_sol,
    0.0::DOUBLE AS raw_delta_rama,
    (l_partkey % 97)::DOUBLE / 9.7::DOUBLE - 5 AS raw_delta_fa_elec,
    -(l_orderkey % 53)::DOUBLE / 19.3::DOUBLE AS raw_delta_fa_pair,
    -l_linenumber::DOUBLE / 4.1::DOUBLE AS raw_delta_hbond_bb_sc,
    CASE WHEN l_linenumber = 7 AND l_discount > 0.08 THEN NULL
      ELSE -(l_partkey % 13)::DOUBLE / 9.9::DOUBLE END AS raw_delta_hbond_sc,
    0.0::DOUBLE AS raw_delta_ref
  FROM lineitem)"""


def with_place(poses: DataFrame) -> DataFrame:
    """Poses with ``xyz``: one atom at a place that the score, part and order give."""
    order, part = F.expr("row_idx div 536870912"), F.col("row_idx") % 1048576
    y, z = (part % 101).cast("double") / 2 - 25, (order % 97).cast("double") / 2 - 24
    return poses.withColumn("xyz", F.array("total_score", y, z))


def relax_poses(spark: SparkSession, folder: str, terms: tuple[str, ...] = INFORMATIVE) -> DataFrame:
    """Prepared states from ``orders``: customers of one supplier form a complex."""
    rows = read(spark, folder, "orders")
    key = F.col("o_orderkey")
    label = (
        F.when(F.col("o_orderstatus") == "F", "crystal")
        .when(F.col("o_orderstatus") == "O", "relax")
        .otherwise("apo_relax")
    )
    group = F.expr("o_custkey div 15")
    energies = [
        F.expr(f"double((o_orderkey * {i + 3}) % {step * 100 + 900}) / 10 - 40 AS {prefix}{x}")
        for step, prefix in enumerate(("raw_", "raw_delta_"))
        for i, x in enumerate(terms)
    ]
    return rows.select(
        F.expr(DATASET.format("(o_custkey div 15)")).alias("dataset"),
        pdb_id(group).alias("pdb"),
        label.alias("type"),
        key.alias("row_idx"),
        (F.col("o_totalprice") / 1000 - 250).alias("total_score"),
        ((key % 400).cast("double") / 4 - 60).alias("idelta_score"),
        ((key % 90).cast("double") / 10).alias("rmsd_to_crystal"),
        *energies,
    )


def relax_sql(terms: tuple[str, ...] = INFORMATIVE) -> str:
    energies = ", ".join(
        f"((o_orderkey * {i + 3}) % {step * 100 + 900})::DOUBLE / 10 - 40 AS {prefix}{t}"
        for step, prefix in enumerate(("raw_", "raw_delta_"))
        for i, t in enumerate(terms)
    )
    return f"""relax_poses AS (
  SELECT {DATASET.format('(o_custkey // 15)')} AS dataset,
    printf('%04d', o_custkey // 15) AS pdb,
    CASE o_orderstatus WHEN 'F' THEN 'crystal' WHEN 'O' THEN 'relax' ELSE 'apo_relax' END AS type,
    o_orderkey AS row_idx,
    o_totalprice / 1000 - 250 AS total_score,
    (o_orderkey % 400)::DOUBLE / 4 - 60 AS idelta_score,
    (o_orderkey % 90)::DOUBLE / 10 AS rmsd_to_crystal,
    {energies}
  FROM orders)"""


RELAX = relax_sql()


def affinity(spark: SparkSession, folder: str) -> DataFrame:
    """Measured affinity per complex from ``supplier``."""
    return read(spark, folder, "supplier").select(
        pdb_id(F.col("s_suppkey")).alias("pdb"),
        F.log10(F.abs(F.col("s_acctbal")) + 1).alias("log_kd"),
    )


AFFINITY = """affinity AS (
  SELECT printf('%04d', s_suppkey) AS pdb, log10(1 + abs(s_acctbal)) AS log_kd FROM supplier)"""


# -- index text ----------------------------------------------------------

MEASURE = (
    "concat(CASE {k} % 5 WHEN 3 THEN 'Ki' WHEN 4 THEN 'IC50' ELSE 'Kd' END, "
    "CASE {k} % 7 WHEN 0 THEN '=' WHEN 1 THEN '=' WHEN 2 THEN '=' WHEN 3 THEN '<=' WHEN 4 THEN '~' "
    "WHEN 5 THEN '>' ELSE '>=' END, {v}, "
    "CASE {k} % 6 WHEN 0 THEN 'mM' WHEN 1 THEN 'uM' WHEN 2 THEN 'nM' WHEN 3 THEN 'pM' WHEN 4 THEN 'fM' "
    "ELSE {other} END)"
)
FLAGS = (
    "CASE {k} % 8 WHEN 0 THEN '' WHEN 1 THEN ' covalent complex' WHEN 2 THEN ' pH 7; mutation: yes' "
    "WHEN 3 THEN ' incomplete ligand structure; isomer' WHEN 4 THEN ' Odd note, ' || {w} "
    "WHEN 5 THEN ' NMR structure' WHEN 6 THEN ' ' || {w} || '; Kd range' ELSE ' ligand is complex' END"
)


def measures(spark: SparkSession, folder: str) -> DataFrame:
    """(pdb, measure): raw measurement text from ``part``."""
    value = "cast(p_size + 1 as string)"
    expr = MEASURE.format(k="p_partkey", v=value, other="'XM'")
    return read(spark, folder, "part").select(
        pdb_id(F.col("p_partkey")).alias("pdb"), F.expr(expr).alias("measure"), "p_partkey", "p_size"
    )


MEASURES = (
    "measures AS (SELECT printf('%04d', p_partkey) AS pdb, "
    + MEASURE.format(k="p_partkey", v="(p_size + 1)::VARCHAR", other="'XM'")
    + " AS measure, p_partkey, p_size FROM part)"
)


def index_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(line): annotated index text from ``part``, with comment lines."""
    measure = MEASURE.format(k="p_partkey", v="cast(p_size + 1 as string)", other="'M'")
    flags = FLAGS.format(k="p_partkey", w="p_name")
    line = (
        "CASE WHEN p_partkey % 50 = 0 THEN '# comment' ELSE concat(format_string('%04d', p_partkey), "
        "'  ', CASE WHEN p_partkey % 11 = 0 THEN 'NMR' ELSE format_string('%d.%d', p_size % 4, p_size % 10) END, "
        f"'  1999  ', {measure}, '   // ', format_string('%04d', p_partkey), '.pdf (', "
        f"CASE WHEN p_partkey % 13 = 0 THEN '4-mer' ELSE 'LIG' END, ')', {flags}) END"
    )
    return read(spark, folder, "part").select("p_partkey", F.expr(line).alias("line"))


INDEX_LINES = (
    "index_lines AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN '# comment' ELSE "
    "concat(printf('%04d', p_partkey), '  ', CASE WHEN p_partkey % 11 = 0 THEN 'NMR' "
    "ELSE printf('%d.%d', p_size % 4, p_size % 10) END, '  1999  ', "
    + MEASURE.format(k="p_partkey", v="(p_size + 1)::VARCHAR", other="'M'")
    + ", '   // ', printf('%04d', p_partkey), '.pdf (', "
    "CASE WHEN p_partkey % 13 = 0 THEN '4-mer' ELSE 'LIG' END, ')', "
    + FLAGS.format(k="p_partkey", w="p_name")
    + ") END AS line FROM part)"
)

# Parsed form of the index text, written independently of the Spark parser.
ANNOTATIONS = (
    INDEX_LINES
    + """, entries AS (
  SELECT regexp_split_to_array(trim(string_split(line, '//')[1]), '\\s+') AS f,
    string_split(line, '//')[2] AS note
  FROM index_lines WHERE line NOT LIKE '#%'),
annotations AS (
  SELECT f[1] AS pdb, f[2] AS resolution, f[4] AS affinity_raw,
    regexp_extract(note, '\\(([^)]*)\\)', 1) AS ligand,
    list_concat(
      CASE WHEN trim(regexp_extract(note, '\\)(.*)$', 1)) = '' THEN []::VARCHAR[]
        ELSE string_split(trim(regexp_extract(note, '\\)(.*)$', 1)), ';') END,
      CASE WHEN note LIKE '%mer)%' THEN ['peptide (xmer)'] ELSE []::VARCHAR[] END) AS flags
  FROM entries)"""
)


# -- features and splits ---------------------------------------------------

SPLIT = "CASE WHEN {b} < {a} THEN 'train' WHEN {b} < {c} THEN 'val' WHEN {b} < {d} THEN 'test' END"


def features(spark: SparkSession, folder: str) -> DataFrame:
    """Feature-table columns from ``orders``, with missing values."""
    rows = read(spark, folder, "orders")
    k = F.col("o_orderkey")
    crystal = (k % 300).cast("double") / 3 - 60
    return rows.select(
        k.cast("string").alias("pdb"),
        F.expr(SPLIT.format(b="(o_orderkey % 100)", a=70, c=80, d=95)).alias("split_a"),
        F.expr(SPLIT.format(b="(o_custkey % 100)", a=60, c=75, d=100)).alias("split_b"),
        F.expr(SPLIT.format(b="((o_orderkey * 7) % 100)", a=90, c=90, d=100)).alias("split_c"),
        F.expr(SPLIT.format(b="((o_custkey * 3) % 100)", a=50, c=70, d=80)).alias("split_d"),
        F.when(k % 17 == 0, F.lit(None).cast("string"))
        .when(k % 3 == 0, "IC50")
        .when(k % 3 == 1, "Ki")
        .otherwise("Kd")
        .alias("affinity_type"),
        (F.col("o_orderstatus") == "F").alias("vague_measures"),
        (k % 19 == 0).alias("covalent"),
        (k % 23 != 0).alias("fully_relaxed"),
        F.when(k % 29 == 0, F.lit(None).cast("double"))
        .otherwise((k % 31).cast("double") / 31)
        .alias("qed"),
        F.when(k % 37 == 0, F.lit(None).cast("boolean")).otherwise(k % 41 == 0).alias("has_rare_element"),
        ((k % 47).cast("double") / 10).alias("rmsd_relax_to_crystal"),
        F.when(k % 53 == 0, F.lit(-200000.0)).otherwise((k % 300).cast("double") / 4 - 50).alias("relax_idelta_score"),
        crystal.alias("crystal_idelta_score"),
        (F.col("o_totalprice") / 1000 - 300).alias("relax_total_score"),
        (F.col("o_totalprice") / 900 - 320).alias("crystal_total_score"),
        (F.col("o_totalprice") / 1100 - 280).alias("ligaway_total_score"),
        ((F.col("o_custkey") % 200).cast("double") / 10 + 2).alias("dG"),
    )


FEATURES = (
    "features AS (SELECT o_orderkey::VARCHAR AS pdb, "
    + SPLIT.format(b="(o_orderkey % 100)", a=70, c=80, d=95) + " AS split_a, "
    + SPLIT.format(b="(o_custkey % 100)", a=60, c=75, d=100) + " AS split_b, "
    + SPLIT.format(b="((o_orderkey * 7) % 100)", a=90, c=90, d=100) + " AS split_c, "
    + SPLIT.format(b="((o_custkey * 3) % 100)", a=50, c=70, d=80) + " AS split_d, "
    """CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'IC50'
      WHEN o_orderkey % 3 = 1 THEN 'Ki' ELSE 'Kd' END AS affinity_type,
    o_orderstatus = 'F' AS vague_measures, o_orderkey % 19 = 0 AS covalent,
    o_orderkey % 23 <> 0 AS fully_relaxed,
    CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE (o_orderkey % 31)::DOUBLE / 31 END AS qed,
    CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE o_orderkey % 41 = 0 END AS has_rare_element,
    (o_orderkey % 47)::DOUBLE / 10 AS rmsd_relax_to_crystal,
    CASE WHEN o_orderkey % 53 = 0 THEN -200000.0::DOUBLE ELSE (o_orderkey % 300)::DOUBLE / 4 - 50 END
      AS relax_idelta_score,
    (o_orderkey % 300)::DOUBLE / 3 - 60 AS crystal_idelta_score,
    o_totalprice / 1000 - 300 AS relax_total_score,
    o_totalprice / 900 - 320 AS crystal_total_score,
    o_totalprice / 1100 - 280 AS ligaway_total_score,
    (o_custkey % 200)::DOUBLE / 10 + 2 AS dG
  FROM orders)"""
)

# Keep-predicates with missing operands spelled out, for the checks.
KEEPS = {
    "affinity_type": "(affinity_type IS DISTINCT FROM 'IC50')",
    "vague_measures": "(NOT vague_measures)",
    "covalent": "(NOT covalent)",
    "fully_relaxed": "fully_relaxed",
    "qed": "coalesce(qed >= 0.2::DOUBLE, false)",
    "has_rare_elem": "coalesce(NOT has_rare_element, false)",
    "rmsd_RelToCry": "(rmsd_relax_to_crystal <= 4.0::DOUBLE)",
    "relax_idelta": "(relax_idelta_score >= -100000)",
}
SPLIT_COLUMNS = ("split_a", "split_b", "split_c", "split_d")


# -- structure text --------------------------------------------------------

def structure_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Structure lines as fields (record TER included), from ``lineitem``."""
    rows = spread(read(spark, folder, "lineitem"))
    k = F.col("l_linenumber")
    record = (
        F.when((F.col("l_quantity") > 49) & (k == 7), "TER").when(k == 6, "HETATM").otherwise("ATOM")
    )
    element = F.expr("element_at(array(' C',' N',' O',' S',' H'), cast(l_partkey % 5 + 1 as int))")
    residue = F.when(
        k == 6,
        F.expr("element_at(array(' ZN',' MG','HOH','ACE','MSE','UNK'), cast(l_orderkey % 6 + 1 as int))"),
    ).otherwise(F.expr("element_at(array('ALA','GLY','SER'), cast(l_partkey % 3 + 1 as int))"))
    name = F.when(k == 6, F.concat(F.lit(" "), residue)).otherwise(F.concat(element, F.lit("A ")))
    number = ((F.col("l_orderkey") * 8 + k) * 64 + F.col("l_quantity").cast("long")) * 1048576
    return rows.select(
        pdb_id(F.col("l_suppkey")).alias("pdb"),
        (number + F.col("l_partkey") % 1048576).alias("line_no"),
        record.alias("record"),
        (F.col("l_orderkey") % 100000).cast("int").alias("atom_no"),
        name.alias("atom_name"),
        residue.alias("residue"),
        F.expr("element_at(array('A','B','C','D'), cast(l_orderkey % 4 + 1 as int))").alias("chain"),
        (F.col("l_partkey") % 1500).cast("int").alias("res_no"),
        (F.col("l_quantity") - 25).alias("x"),
        ((F.col("l_partkey") % 101).cast("double") / 2 - 25).alias("y"),
        ((F.col("l_orderkey") % 97).cast("double") / 2 - 24).alias("z"),
        element.alias("element"),
    )


def structure_atoms(spark: SparkSession, folder: str) -> DataFrame:
    return structure_rows(spark, folder).where("record <> 'TER'")


def structure_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(pdb, line_no, line): the same rows as fixed-width text."""

    def padded(value: Column, width: int) -> Column:
        return F.lpad(value.cast("string"), width, " ")

    fields = F.concat(
        F.rpad("record", 6, " "),
        padded(F.col("atom_no"), 5),
        F.lit(" "),
        F.col("atom_name"),
        F.lit(" "),
        F.col("residue"),
        F.lit(" "),
        F.col("chain"),
        padded(F.col("res_no"), 4),
        F.lit("    "),
        *[padded(F.col(c).cast("decimal(8,3)"), 8) for c in "xyz"],
        F.lit("  1.00  0.00          "),
        F.col("element"),
    )
    line = F.when(F.col("record") == "TER", "TER").otherwise(fields)
    # A list of one: else Spark writes the whole text anew for every field that is cut from it.
    return structure_rows(spark, folder).select("pdb", "line_no", F.explode(F.array(line)).alias("line"))


# Fields of the structure lines, taken from the table rather than the text.
ATOMS = """all_lines AS (
  SELECT printf('%04d', l_suppkey) AS pdb,
    ((l_orderkey * 8 + l_linenumber) * 64 + l_quantity::BIGINT) * 1048576 + l_partkey % 1048576 AS line_no,
    CASE WHEN l_quantity > 49 AND l_linenumber = 7 THEN 'TER' WHEN l_linenumber = 6 THEN 'HETATM'
      ELSE 'ATOM' END AS record,
    (l_orderkey % 100000)::INTEGER AS atom_no,
    CASE WHEN l_linenumber = 6 THEN ' ' || [' ZN',' MG','HOH','ACE','MSE','UNK'][l_orderkey % 6 + 1]
      ELSE [' C',' N',' O',' S',' H'][l_partkey % 5 + 1] || 'A ' END AS atom_name,
    CASE WHEN l_linenumber = 6 THEN [' ZN',' MG','HOH','ACE','MSE','UNK'][l_orderkey % 6 + 1]
      ELSE ['ALA','GLY','SER'][l_partkey % 3 + 1] END AS residue,
    ['A','B','C','D'][l_orderkey % 4 + 1] AS chain,
    (l_partkey % 1500)::INTEGER AS res_no,
    l_quantity - 25 AS x,
    (l_partkey % 101)::DOUBLE / 2 - 25 AS y,
    (l_orderkey % 97)::DOUBLE / 2 - 24 AS z,
    [' C',' N',' O',' S',' H'][l_partkey % 5 + 1] AS element
  FROM lineitem),
atoms AS (SELECT * FROM all_lines WHERE record <> 'TER')"""


def ligand_points(spark: SparkSession, folder: str) -> DataFrame:
    """(pdb, x, y, z): ligand atoms from ``supplier`` (four per complex)."""
    rows = read(spark, folder, "supplier")
    k = F.col("s_suppkey")
    step = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")
    i = F.col("i")
    return rows.select("s_suppkey", step).select(
        pdb_id(k).alias("pdb"),
        ((k * 7 + i * 5) % 50 - 25).cast("double").alias("x"),
        (((k * 11 + i * 3) % 100).cast("double") / 2 - 25).alias("y"),
        (((k * 13 + i * 9) % 96).cast("double") / 2 - 24).alias("z"),
    )


LIGAND = """ligand AS (
  SELECT printf('%04d', s_suppkey) AS pdb, ((s_suppkey * 7 + i * 5) % 50 - 25)::DOUBLE AS x,
    ((s_suppkey * 11 + i * 3) % 100)::DOUBLE / 2 - 25 AS y,
    ((s_suppkey * 13 + i * 9) % 96)::DOUBLE / 2 - 24 AS z
  FROM supplier, range(4) AS r(i))"""

HITS = """hits AS (
  SELECT a.* FROM atoms a WHERE EXISTS (
    SELECT 1 FROM ligand l WHERE l.pdb = a.pdb AND
      (a.x - l.x) * (a.x - l.x) + (a.y - l.y) * (a.y - l.y) + (a.z - l.z) * (a.z - l.z) <= 49.0))"""

BLOCKS = """blocks AS (
  SELECT *, (sum(CASE WHEN record = 'TER' THEN 1 ELSE 0 END)
    OVER (PARTITION BY pdb ORDER BY line_no ROWS UNBOUNDED PRECEDING))::BIGINT AS ter_block
  FROM all_lines)"""

CONTACTS = """last_block AS (SELECT pdb, max(ter_block) AS last FROM blocks WHERE record <> 'TER' GROUP BY pdb),
near AS (SELECT h.*, b.ter_block, b.ter_block = t.last AS tail FROM hits h
  JOIN blocks b USING (pdb, line_no) JOIN last_block t USING (pdb)),
contacts AS (
  SELECT DISTINCT pdb, 'chain' AS role, chain AS name, NULL::INTEGER AS atom_no FROM near WHERE record = 'ATOM'
  UNION ALL SELECT DISTINCT pdb, 'co_ligand', residue, NULL FROM near WHERE record = 'HETATM' AND tail
  UNION ALL SELECT DISTINCT pdb, 'cofactor', atom_name, atom_no FROM near
    WHERE record = 'HETATM' AND tail AND residue IN (' ZN', ' MG')
  UNION ALL SELECT DISTINCT pdb, 'modified', residue, NULL FROM near WHERE record = 'HETATM' AND NOT tail),
chain_sizes AS (
  SELECT i.pdb, coalesce(s.size, 0) AS size FROM (SELECT DISTINCT pdb FROM atoms) i LEFT JOIN (
    SELECT a.pdb, count(DISTINCT (a.chain, a.res_no)) AS size FROM atoms a
    WHERE EXISTS (SELECT 1 FROM contacts c WHERE c.role = 'chain' AND c.pdb = a.pdb AND c.name = a.chain)
    GROUP BY a.pdb) s USING (pdb)),
verdict AS (
  SELECT s.pdb, s.size, CASE WHEN s.size > 560 THEN 'size'
    WHEN EXISTS (SELECT 1 FROM contacts c WHERE c.pdb = s.pdb AND c.role = 'co_ligand'
      AND c.name NOT IN (' ZN', ' MG', ' MN', ' CA', ' NA', '  K', ' FE', ' NI', ' CO', 'FE2', 'HOH')) THEN 'co ligand'
    WHEN EXISTS (SELECT 1 FROM contacts c WHERE c.pdb = s.pdb AND c.role = 'modified') THEN 'mutated residue'
    ELSE 'kept' END AS reason
  FROM chain_sizes s)"""


# -- logs ------------------------------------------------------------------

LOG_WORDS = {
    "index_error": ("tion",),
    "oserror": ("que ",),
    "unrecognized_residue": ("sch",),
    "variant": (" und",),
    "disulfide": ("eaux",),
    "missing_atom": ("ción",),
    "oom": ("ss.", "@"),
    "keyerror": ("http",),
}


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(job, family, line_no, line): text lines of ``documents``."""
    rows = read(spark, folder, "documents")
    job = F.concat_ws("_", "source", F.col("doc_id").cast("string"))
    return rows.select(
        job.alias("job"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )


LOG_LINES = """log_lines AS (
  SELECT job, (u.i - 1)::INTEGER AS line_no, u.line AS line FROM (
    SELECT source || '_' || doc_id::VARCHAR AS job, string_split(text, chr(10)) AS parts FROM documents) d,
    LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS line) u)"""


# -- pose coordinates --------------------------------------------------------

def coordinates(spark: SparkSession, folder: str) -> DataFrame:
    """(pdb, row_idx, score, xyz): 22 atoms per pose from ``embeddings``, whose 64 numbers two zeros complete."""
    return read(spark, folder, "embeddings").select(
        pdb_id(F.col("label")).alias("pdb"),
        F.col("vec_id").alias("row_idx"),
        F.col("embedding")[0].cast("double").alias("score"),
        F.concat(F.col("embedding").cast("array<double>"), F.lit([0.0, 0.0])).alias("xyz"),
    )


COORDS = """coords AS (
  SELECT printf('%04d', label) AS pdb, vec_id AS row_idx, embedding[1]::DOUBLE AS score,
    list_concat(embedding::DOUBLE[], [0.0::DOUBLE, 0.0::DOUBLE]) AS xyz FROM embeddings)"""

# Leaders: poses by ascending score, kept when no earlier leader is near.
CLUSTERS = COORDS + """, leaders AS (
  SELECT pdb, unnest(list_reduce(list([{'r': row_idx, 's': score, 'x': xyz}] ORDER BY score, row_idx),
    lambda acc, p: CASE WHEN len(list_filter(acc, lambda l: list_distance(l.x, p[1].x) / sqrt(22) < 0.3)) > 0
      THEN acc ELSE list_concat(acc, p) END)) AS l
  FROM coords GROUP BY pdb),
members AS (
  SELECT c.pdb, c.row_idx, l.r AS cluster_id, c.row_idx = l.r AS is_rep, c.score,
    list_distance(l.x, c.xyz) / sqrt(22) AS rmsd
  FROM coords c JOIN leaders d ON c.pdb = d.pdb AND (l.s < c.score OR (l.s = c.score AND l.r <= c.row_idx))
  QUALIFY row_number() OVER (PARTITION BY c.pdb, c.row_idx ORDER BY list_distance(l.x, c.xyz), l.s, l.r) = 1)"""
