"""Clustering, fits, experiment grid and the feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from posequarry.fixed_values import (
    COMMON_LIGAND_ELEMENTS,
    COMMON_RECEPTOR_ELEMENTS,
    FEATURE_TERMS,
)
from posequarry.functions import coords
from posequarry.operators import (
    annotations,
    clustering,
    features,
    fitting,
    splits,
    structure,
)
from posequarry.operators.aggregate import (
    keep_non_positive,
    keep_refined_perturbed,
    lowest_pose,
)
from posequarry.plans import driver_tables as t
from posequarry.plans import experiment, fit_sql
from posequarry.plans.catalog import query, r6, with_views
from posequarry.plans.queries_sources import SUBSET
from posequarry.session import materialize
from posequarry.sources.splits import membership

CUTOFF = 0.3


def working_set(spark, folder):
    return keep_non_positive(keep_refined_perturbed(t.poses(spark, folder)))


def grid(spark, folder):
    return experiment.Grid(working_set(spark, folder), t.affinity(spark, folder))


def whole_grid(spark, folder):
    """The grid with its clustered experiments, whose clusters are made first."""
    poses = working_set(spark, folder)
    members = materialize(clustering.cluster_poses(t.with_place(poses), 2.0, "idelta_score"))
    experiments = [*experiment.DEFAULT_EXPERIMENTS, *experiment.clustered_experiments(2.0)]
    return experiment.Grid(poses, t.affinity(spark, folder), experiments, cluster_members=members)


# -- clustering -----------------------------------------------------------------


MEMBERS = "SELECT pdb, row_idx, cluster_id, is_rep, round(rmsd, 6) AS rmsd FROM members"


@query("C1_leader_clusters", with_views(t.CLUSTERS, body=MEMBERS))
def leader_clusters(spark, folder):
    members = clustering.cluster_poses(t.coordinates(spark, folder), CUTOFF)
    return members.withColumn("rmsd", F.round("rmsd", 6))


@query(
    "C2_pose_rmsd",
    with_views(t.COORDS, """best AS (SELECT pdb, xyz AS ref FROM coords
        QUALIFY row_number() OVER (PARTITION BY pdb ORDER BY score, row_idx) = 1)""", body="""
      SELECT pdb, row_idx, round(sqrt(list_sum(list_transform(range(1, 67), lambda i: (xyz[i] - ref[i]) * (xyz[i] - ref[i]))) / 22), 6) AS rmsd
      FROM coords JOIN best USING (pdb)"""),
)
def pose_rmsd(spark, folder):
    rows = t.coordinates(spark, folder)
    best = lowest_pose(rows, ["pdb"], "score").select("pdb", F.col("xyz").alias("ref"))
    return rows.join(best, "pdb").select(
        "pdb", "row_idx", r6(coords.rmsd(F.col("xyz"), F.col("ref")), "rmsd")
    )


@query("C3_cluster_all", with_views(t.CLUSTERS, body=MEMBERS))
def cluster_all(spark, folder):
    """Sliced form of the clustering, as used for very large complexes."""
    members = clustering.cluster_poses(
        t.coordinates(spark, folder), CUTOFF, group_rows=45, head_rows=8, slice_rows=16, block_rows=4
    )
    return members.withColumn("rmsd", F.round("rmsd", 6))


@query(
    "C4_coordinates",
    """SELECT printf('%04d', l_suppkey) AS pdb, l_orderkey AS row_idx,
      array_to_string(list(printf('%.3f,%.3f,%.3f', l_quantity - 25, (l_partkey % 101)::DOUBLE / 2 - 25,
        (l_orderkey % 97)::DOUBLE / 2 - 24) ORDER BY l_linenumber, l_quantity, (l_partkey % 101)), ' ') AS xyz
      FROM lineitem GROUP BY ALL""",
)
def coordinates(spark, folder):
    """Ligand lines with one atom name per line number, put in map order."""
    rows = t.read(spark, folder, "lineitem")
    name = F.format_string(" L%d ", "l_linenumber")

    def padded(value):
        return F.lpad(value.cast("decimal(8,3)").cast("string"), 8, " ")

    line = F.concat(
        F.lit("HETATM    1 "),
        name,
        F.lit(" UNK X   1    "),
        padded(F.col("l_quantity") - 25),
        padded((F.col("l_partkey") % 101).cast("double") / 2 - 25),
        padded((F.col("l_orderkey") % 97).cast("double") / 2 - 24),
    )
    pdb = t.pdb_id(F.col("l_suppkey")).alias("pdb")
    lines = rows.select(pdb, F.col("l_orderkey").alias("row_idx"), line.alias("line"))
    atom_map = rows.select(
        pdb, name.alias("atom_name"), F.col("l_linenumber").alias("atom_index")
    ).distinct()
    found = structure.pose_coordinates(lines, atom_map)
    numbers = F.transform("xyz", lambda v: v.cast("decimal(8,3)").cast("string"))
    triples = F.transform(
        F.sequence(F.lit(1), F.size("xyz"), F.lit(3)), lambda i: F.array_join(F.slice(numbers, i, 3), ",")
    )
    return found.select("pdb", "row_idx", F.array_join(triples, " ").alias("xyz"))


@query(
    "C5_cluster_export",
    with_views(t.CLUSTERS, body="""SELECT pdb, cluster_id AS representative, 0 AS part, count(*) AS size,
      array_to_string(list(row_idx ORDER BY rmsd, row_idx), ',') AS members FROM members GROUP BY ALL"""),
)
def cluster_export(spark, folder):
    members = clustering.cluster_poses(t.coordinates(spark, folder), CUTOFF)
    lists = clustering.nested_clusters(members)
    return lists.select(
        "pdb", "representative", "part", F.col("size").cast("long").alias("size"), F.array_join(F.col("members").cast("array<string>"), ",").alias("members")
    )


# -- experiment grid ---------------------------------------------------------------

HB = "raw_delta_hbond_bb_sc + coalesce(raw_delta_hbond_sc, 0)"
# Representatives at a cutoff of 2: poses by ascending score, kept when no earlier one kept is near.
REPRESENTATIVES = """posed AS (SELECT pdb, row_idx, idelta_score, [total_score, (row_idx % 1048576 % 101)::DOUBLE / 2 - 25,
    (row_idx // 536870912 % 97)::DOUBLE / 2 - 24] AS xyz FROM subset),
reps AS (SELECT pdb, unnest(list_reduce(list([{'r': row_idx, 'x': xyz}] ORDER BY idelta_score, row_idx),
    lambda acc, p: CASE WHEN len(list_filter(acc, lambda l: list_distance(l.x, p[1].x) < 2.0)) > 0
      THEN acc ELSE list_concat(acc, p) END)).r AS row_idx FROM posed GROUP BY pdb)"""
# A representative without a feature is left out of the selections that use it; all_terms alone has such features.
CLUSTERED_LEVELS = """ UNION ALL SELECT 'clustered_2.0', s.selection, rows.* FROM rows JOIN reps USING (pdb, row_idx),
    (VALUES ('all_terms'), ('rest')) s(selection) WHERE s.selection = 'rest' OR raw_delta_hbond_sc IS NOT NULL"""


def grid_sql(clustered: bool) -> str:
    return f"""rows AS (SELECT *, {HB} AS hb, raw_delta_fa_atr + raw_delta_fa_rep AS vdw,
    row_number() OVER (PARTITION BY pdb ORDER BY idelta_score, row_idx) AS rn FROM subset),
levels AS (SELECT 'min' AS aggregation, NULL::VARCHAR AS selection, * FROM rows WHERE rn = 1
  UNION ALL SELECT 'mean10', NULL::VARCHAR, * FROM rows WHERE rn <= 10
  UNION ALL SELECT 'filtered_mean', NULL::VARCHAR, * FROM rows{CLUSTERED_LEVELS if clustered else ''}),
per AS (SELECT aggregation, selection, pdb, any_value(log_kd) AS log_kd, avg(idelta_score) AS s, avg(raw_delta_fa_atr) AS atr,
  avg(raw_delta_fa_rep) AS rep, avg(raw_delta_fa_sol) AS sol, avg(raw_delta_fa_elec) AS elec, avg(raw_delta_fa_pair) AS pair,
  avg(raw_delta_hbond_bb_sc) AS bb, avg(raw_delta_hbond_sc) AS sc, avg(hb) AS hb, avg(vdw) AS vdw
  FROM levels GROUP BY aggregation, selection, pdb),
per_all AS (SELECT * FROM per WHERE sc IS NOT NULL AND selection IS DISTINCT FROM 'rest'),
per_rest AS (SELECT * FROM per WHERE selection IS DISTINCT FROM 'all_terms'),
scatter AS (SELECT aggregation, 'all_terms' AS term_selection, pdb, log_kd, s AS agg_score FROM per_all
  UNION ALL SELECT aggregation, 'combined_hbond', pdb, log_kd,
    0.8::DOUBLE * atr + 0.4::DOUBLE * rep + 0.6::DOUBLE * sol + 0.42::DOUBLE * elec + 0.8::DOUBLE * pair + 1.3::DOUBLE * hb FROM per_rest
  UNION ALL SELECT aggregation, 'no_sol_pair', pdb, log_kd, 0.8::DOUBLE * atr + 0.4::DOUBLE * rep + 0.42::DOUBLE * elec + 1.3::DOUBLE * hb FROM per_rest
  UNION ALL SELECT aggregation, 'combined_vdw', pdb, log_kd, 0.42::DOUBLE * elec + 1.3::DOUBLE * hb + 0.6::DOUBLE * vdw FROM per_rest)"""


GRID_VIEWS = (t.POSES, t.AFFINITY, SUBSET, grid_sql(False))
WHOLE_GRID_VIEWS = (t.POSES, t.AFFINITY, SUBSET, REPRESENTATIVES, grid_sql(True))


@query(
    "M1_hash_split",
    """SELECT pdb, CASE WHEN b < 80 THEN 'train' ELSE 'test' END AS part FROM (
      SELECT o_orderkey::VARCHAR AS pdb, ('0x' || substr(md5(o_orderkey::VARCHAR || ':42'), 1, 8))::UBIGINT % 100 AS b FROM orders)""",
)
def hash_split(spark, folder):
    ids = t.read(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("pdb"))
    return ids.withColumn("part", splits.hash_split(F.col("pdb")))


TERMS_OF = {
    "all_terms": ("atr", "rep", "sol", "elec", "pair", "bb", "sc"),
    "combined_hbond": ("atr", "rep", "sol", "elec", "pair", "hb"),
    "no_sol_pair": ("atr", "rep", "elec", "hb"),
    "combined_vdw": ("elec", "hb", "vdw"),
}
TERM_NAMES = {
    "atr": "fa_atr", "rep": "fa_rep", "sol": "fa_sol", "elec": "fa_elec", "pair": "fa_pair",
    "bb": "hbond_bb_sc", "sc": "hbond_sc", "hb": "hbond_combined", "vdw": "fa_vdw",
}
FRAME = "frame AS MATERIALIZED (" + " UNION ALL ".join(
    f"""SELECT aggregation || '__{name}' AS config,
      CASE WHEN ('0x' || substr(md5(pdb || ':42'), 1, 8))::UBIGINT % 100 < 80 THEN 'train' ELSE 'test' END AS part,
      log_kd AS y, [{', '.join([*columns, *['0.0::DOUBLE'] * (7 - len(columns))])}] AS x
    FROM {'per_all' if name == 'all_terms' else 'per_rest'}"""
    for name, columns in TERMS_OF.items()
) + ")"
NAMED = "named AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{name}', {i}, 'raw_delta_{TERM_NAMES[c]}')"
    for name, columns in TERMS_OF.items()
    for i, c in enumerate(columns, start=1)
) + ") v(terms, i, energy_term))"
FIT = fit_sql.fit_views(fitting.start_weights(7, 42).tolist(), 2000, 1e-3)


@query(
    "M2_reweighting_fit",
    fit_sql.with_recursion(*GRID_VIEWS, FRAME, FIT, NAMED, body="""SELECT config, energy_term, round(w[i], 6) AS weight
      FROM fitted JOIN named ON string_split(config, '__')[2] = terms"""),
)
def reweighting_fit(spark, folder):
    """Learned weights of all twelve configurations."""
    g = grid(spark, folder)
    weights = fitting.fit_weights(g.training_frame())
    return g.named_weights(weights).select("config", "energy_term", r6("weight", "weight"))


@query(
    "M2_least_squares_fit",
    fit_sql.with_recursion(*GRID_VIEWS, FRAME, FIT, fit_sql.predicted_view(7), body="""
      SELECT config, round(avg(abs(y - prediction)), 6) AS stepwise_mae, TRUE AS reached
      FROM predicted WHERE part = 'train' GROUP BY config"""),
)
def least_squares_fit(spark, folder):
    """Does reweighted least squares reach the error of the stepwise fit, or a lower one?"""
    frame = materialize(grid(spark, folder).training_frame())

    def error(weights, name):
        metrics = fitting.fit_metrics(fitting.predict(frame, weights))
        return metrics.where("part = 'train'").select("config", F.col("mae").alias(name))

    stepwise = error(fitting.fit_weights(frame), "stepwise")
    squares = error(fitting.fit_reweighted(frame), "squares")
    reached = F.col("squares") <= F.col("stepwise") + 1e-6
    return stepwise.join(squares, "config").select("config", r6("stepwise", "stepwise_mae"), reached.alias("reached"))


SOFTPLUS_FRAME = """frame AS MATERIALIZED (SELECT coalesce(affinity_type, 'unknown') AS config, split_a AS part, pdb, -dG AS y,
  [relax_idelta_score / 50, crystal_idelta_score / 50, relax_total_score / 100] AS x FROM features
  WHERE relax_idelta_score >= -100000 AND split_a IS NOT NULL)"""


@query(
    "M3_softplus_fit",
    fit_sql.with_recursion(
        t.FEATURES,
        SOFTPLUS_FRAME,
        fit_sql.batch_fit_views(fitting.start_weights(3, 42).tolist(), 100, 0.05, 512),
        fit_sql.predicted_view(3),
        body="""SELECT config, part, round(corr(y, prediction), 6) AS r, round(avg(abs(y - prediction)), 6) AS mae,
          round(sqrt(avg(pow(y - prediction, 2))), 6) AS rmse, count(*) AS n FROM predicted GROUP BY config, part""",
    ),
)
def softplus_fit(spark, folder):
    """Positive weights per affinity type: 100 epochs of mini-batches of 512, the best epoch by validation error."""
    rows = t.features(spark, folder).where("relax_idelta_score >= -100000")
    frame = rows.select(
        F.coalesce("affinity_type", F.lit("unknown")).alias("config"),
        F.col("split_a").alias("part"),
        "pdb",
        (-F.col("dG")).alias("y"),
        (F.col("relax_idelta_score") / 50).alias("x0"),
        (F.col("crystal_idelta_score") / 50).alias("x1"),
        (F.col("relax_total_score") / 100).alias("x2"),
    ).where(F.col("part").isNotNull())
    weights = fitting.fit_weights(frame, "softplus", epochs=100, lr=0.05, validate=True, batch=512)
    metrics = fitting.fit_metrics(fitting.predict(frame, weights))
    return metrics.select("config", "part", r6("r", "r"), r6("mae", "mae"), r6("rmse", "rmse"), "n")


@query(
    "M4_predict",
    with_views(*GRID_VIEWS, body=" UNION ALL ".join(
        f"""SELECT aggregation || '__{name}' AS config, pdb,
          round({' + '.join(f'{2.0 ** -(i + 1)}::DOUBLE * {c}' for i, c in enumerate(columns))}, 6) AS prediction
        FROM {'per_all' if name == 'all_terms' else 'per_rest'}"""
        for name, columns in TERMS_OF.items())),
)
def predict(spark, folder):
    """Predictions of all configurations, with weights that halve from term to term."""
    frame = grid(spark, folder).training_frame()
    halving = F.lit([2.0 ** -(i + 1) for i in range(len(fitting.feature_names(frame)))])
    configs = frame.select("config").distinct()
    weights = configs.select("config", F.posexplode(halving).alias("position", "weight"))
    predicted = fitting.predict(frame, weights)
    return predicted.select("config", "pdb", r6("prediction", "prediction"))


@query(
    "M5_baseline_grid",
    with_views(*WHOLE_GRID_VIEWS, body="""SELECT aggregation, term_selection, round(corr(log_kd, agg_score), 6) AS r,
      round(avg(abs(log_kd - agg_score)), 6) AS mae, count(*) AS n FROM scatter GROUP BY ALL"""),
)
def baseline_grid(spark, folder):
    rows = whole_grid(spark, folder).baseline()
    return rows.select("aggregation", "term_selection", r6("r", "r"), r6("mae", "mae"), "n")


@query(
    "M6_results_matrix",
    fit_sql.with_recursion(*WHOLE_GRID_VIEWS, FRAME, FIT, fit_sql.predicted_view(7), NAMED, body="""
      SELECT string_split(config, '__')[1] AS aggregation, string_split(config, '__')[2] AS term_selection,
        round(corr(y, prediction) FILTER (WHERE part = 'train'), 6) AS r_train,
        round(corr(y, prediction) FILTER (WHERE part = 'test'), 6) AS r_test,
        round(avg(abs(y - prediction)) FILTER (WHERE part = 'train'), 6) AS mae_train,
        round(avg(abs(y - prediction)) FILTER (WHERE part = 'test'), 6) AS mae_test,
        (SELECT count(*) FROM named WHERE terms = string_split(config, '__')[2]) AS n_features
      FROM predicted GROUP BY config"""),
)
def results_matrix(spark, folder):
    """Results matrix of the whole grid, fitted step by step."""
    g = whole_grid(spark, folder)
    frame = materialize(g.training_frame())
    rows = g.results(fitting.fit_weights(frame), frame)
    return rows.select(
        "aggregation",
        "term_selection",
        *[r6(c, c) for c in ("r_train", "r_test", "mae_train", "mae_test")],
        F.col("n_features").cast("long").alias("n_features"),
    )


@query(
    "M7_scatter",
    with_views(*WHOLE_GRID_VIEWS, body="""SELECT aggregation, term_selection, pdb, round(log_kd, 6) AS log_kd,
      round(agg_score, 6) AS agg_score FROM scatter"""),
)
def scatter(spark, folder):
    rows = whole_grid(spark, folder).scatter()
    return rows.select(
        "aggregation", "term_selection", "pdb", r6("log_kd", "log_kd"), r6("agg_score", "agg_score")
    )


# -- feature table -------------------------------------------------------------------

F1_SPLITS = ("ext_split", "list_split", "json_split", "table_split")


def feature_table(spark, folder):
    relax = t.relax_poses(spark, folder, FEATURE_TERMS)
    state = F.when(F.col("type") == "apo_relax", "ligaway").otherwise(F.col("type"))
    states = relax.withColumn("state", state)
    supplier = t.read(spark, folder, "supplier").select(
        t.pdb_id(F.col("s_suppkey")).alias("pdb"), "s_suppkey", "s_acctbal"
    )
    ids = supplier.select("pdb", (F.col("s_acctbal") > -500).alias("healthy"))
    affinity = supplier.select(
        "pdb",
        F.when(F.col("s_suppkey") % 4 == 0, "test").otherwise("train").alias("new_split"),
        F.format_string(
            "%s%s%d%s",
            F.when(F.col("s_suppkey") % 2 == 0, "Ki").otherwise("Kd"),
            F.when(F.col("s_suppkey") % 3 == 0, ">=").otherwise("="),
            F.col("s_suppkey") % 50 + 1,
            F.when(F.col("s_suppkey") % 5 == 0, "mM").otherwise("nM"),
        ).alias("kd/ki"),
        (F.col("s_suppkey") % 7 == 0).alias("covalent"),
    )
    k = F.col("s_suppkey")
    members = (
        membership(supplier.where(k % 3 == 0), "ext_split", "train", 1)
        .unionByName(membership(supplier.where(k % 2 == 0), "list_split", "train", 1))
        .unionByName(membership(supplier.where(k % 3 == 0), "list_split", "test", 2))
        .unionByName(membership(supplier.where(k % 5 == 0), "list_split", "val", 3))
        .unionByName(membership(supplier.where(k % 4 == 1), "json_split", "test", 2))
    )
    atoms = t.structure_atoms(spark, folder)
    facts = features.residue_counts(atoms).join(
        annotations.rare_element_flag(atoms, COMMON_RECEPTOR_ELEMENTS, COMMON_LIGAND_ELEMENTS), "pdb"
    )
    facts = facts.withColumn("qed", F.col("nres").cast("double") / 1000)
    return features.feature_table(
        ids, affinity, members, F1_SPLITS, "table_split", states, facts
    )


STATE_SQL = ", ".join(
    f"max(CASE WHEN type = '{source}' THEN {column} END) AS {name}"
    for name, source, column in [
        ("rmsd_relax_to_crystal", "relax", "rmsd_to_crystal"),
        ("crystal_total_score", "crystal", "total_score"),
        ("relax_total_score", "relax", "total_score"),
        ("ligaway_total_score", "apo_relax", "total_score"),
        ("crystal_idelta_score", "crystal", "idelta_score"),
        ("relax_idelta_score", "relax", "idelta_score"),
    ]
    + [
        (f"{prefix}{x}", source, f"{column}{x}")
        for prefix, source, column in (
            ("crystal_idelta_", "crystal", "raw_delta_"),
            ("relax_idelta_", "relax", "raw_delta_"),
            ("relax_total_", "relax", "raw_"),
            ("ligaway_total_", "apo_relax", "raw_"),
        )
        for x in FEATURE_TERMS
    ]
)
STATE_COLUMNS = features.feature_columns(F1_SPLITS)[12:]


@query(
    "F1_feature_table",
    with_views(t.relax_sql(FEATURE_TERMS), t.ATOMS, f"""firsts AS (SELECT * FROM relax_poses
        QUALIFY row_number() OVER (PARTITION BY pdb, type ORDER BY row_idx) = 1),
      states AS (SELECT pdb, count(*) AS n_states, {STATE_SQL} FROM firsts GROUP BY pdb),
      facts AS (SELECT pdb, count(DISTINCT (chain, res_no)) AS nres, false AS has_rare_element FROM atoms GROUP BY pdb)""",
        body=f"""SELECT s.pdb, CASE WHEN k % 3 = 0 THEN 'train' END AS ext_split,
      CASE WHEN k % 2 = 0 THEN 'train' WHEN k % 3 = 0 THEN 'test' WHEN k % 5 = 0 THEN 'val' END AS list_split,
      CASE WHEN k % 4 = 1 THEN 'test' END AS json_split, CASE WHEN k % 4 = 0 THEN 'test' ELSE 'train' END AS table_split,
      CASE WHEN k % 2 = 0 THEN 'Ki' ELSE 'Kd' END AS affinity_type,
      round(-1.987::DOUBLE * 298.15::DOUBLE * ln((k % 50 + 1) * CASE WHEN k % 5 = 0 THEN 1e-3 ELSE 1e-9 END) / 1000, 6) AS dG,
      k % 3 = 0 AS vague_measures, k % 7 = 0 AS covalent, s_acctbal > -500 AND coalesce(n_states, 0) = 3 AS fully_relaxed,
      nres, round(nres / 1000, 6) AS qed, has_rare_element, {', '.join(f'round({c}, 6) AS {c}' for c in STATE_COLUMNS)}
      FROM (SELECT printf('%04d', s_suppkey) AS pdb, s_suppkey AS k, s_acctbal FROM supplier) s
      LEFT JOIN states USING (pdb) LEFT JOIN facts USING (pdb)"""),
)
def rounded_feature_table(spark, folder):
    rows = feature_table(spark, folder)
    numeric = {"dG", "qed", *STATE_COLUMNS}
    return rows.select(*[r6(c, c) if c in numeric else F.col(c) for c in rows.columns])
