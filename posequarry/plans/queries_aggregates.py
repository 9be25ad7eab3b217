"""Aggregations, histograms and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from posequarry.fixed_values import ALLOWED_FLAGS, STAGE_TARGETS
from posequarry.functions import delta, metrics
from posequarry.operators import (
    aggregate,
    annotations,
    clustering,
    contacts,
    density,
    features,
    filters,
    progress,
    quantiles,
)
from posequarry.operators.ordering import first_per_key
from posequarry.plans import driver_tables as t
from posequarry.plans.catalog import n_rows, query, r6, with_views
from posequarry.plans.queries_columns import (
    LIGAND_ATOM_ROWS,
    REASONED,
    annotated,
    ligand_profile_rows,
    word_pairs,
)
from posequarry.plans.queries_joins import contact_parts
from posequarry.plans.queries_sources import PROBE, SUBSET, ligand_file_lines
from posequarry.session import scratch_path
from posequarry.sources.index import ligand_probe
from posequarry.sources.store import filtered_subset
from posequarry.streaming import ingest

FEATURES = tuple(f"raw_delta_{x}" for x in t.INFORMATIVE)


def subset(spark, folder):
    return filtered_subset(t.poses(spark, folder), t.affinity(spark, folder))


def rounded(df, keys=("pdb",)):
    return df.select(*keys, *[r6(F.col(f"`{c}`"), c) for c in df.columns if c not in keys])


MEANS = ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("idelta_score", *FEATURES))
VALUES = ", ".join(f"round({c}, 6) AS {c}" for c in ("idelta_score", *FEATURES))
RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY pdb ORDER BY idelta_score, row_idx) AS rn FROM subset)"""


def aggregated(spark, folder, strategy):
    rows = t.poses(spark, folder)
    rows = aggregate.keep_non_positive(aggregate.keep_refined_perturbed(rows))
    return aggregate.aggregate_per_pdb(rows, strategy=strategy, n=10, extra_cols=FEATURES)


@query(
    "A1_min",
    with_views(t.POSES, t.AFFINITY, SUBSET, RANKED, body=f"SELECT pdb, {VALUES}, 1.0::DOUBLE AS sample_weight FROM ranked WHERE rn = 1"),
)
def lowest(spark, folder):
    return rounded(aggregated(spark, folder, "min"))


@query(
    "A2_mean_n",
    with_views(t.POSES, t.AFFINITY, SUBSET, RANKED, body=f"SELECT pdb, {MEANS}, 1.0::DOUBLE AS sample_weight FROM ranked WHERE rn <= 10 GROUP BY pdb"),
)
def mean_n(spark, folder):
    return rounded(aggregated(spark, folder, "mean_n"))


@query(
    "A3_best_pose_per_label",
    with_views(t.RELAX, body="""SELECT pdb, type, row_idx, round(total_score, 6) AS total_score FROM relax_poses
      QUALIFY row_number() OVER (PARTITION BY pdb, type ORDER BY total_score, row_idx) = 1"""),
)
def best_pose(spark, folder):
    rows = aggregate.lowest_pose(t.relax_poses(spark, folder), ["pdb", "type"], "total_score")
    return rows.select("pdb", "type", "row_idx", r6("total_score", "total_score"))


@query(
    "A4_filtered_mean",
    with_views(t.POSES, t.AFFINITY, SUBSET, body=f"SELECT pdb, {MEANS}, 1.0::DOUBLE AS sample_weight FROM subset GROUP BY pdb"),
)
def filtered_mean(spark, folder):
    return rounded(aggregated(spark, folder, "filtered_mean"))


@query(
    "A5_clustered",
    with_views(t.CLUSTERS, body="SELECT pdb, round(score, 6) AS score, 1.0::DOUBLE AS sample_weight FROM members WHERE is_rep"),
)
def clustered(spark, folder):
    poses = t.coordinates(spark, folder)
    members = clustering.cluster_poses(poses, 0.3)
    rows = aggregate.aggregate_per_pdb(
        poses, score_col="score", strategy="clustered", cluster_members=members
    )
    return rounded(rows)


@query(
    "A6_weighted_collapse",
    with_views(t.POSES, t.AFFINITY, body="""SELECT pdb, CASE WHEN sum(w) = 0 THEN round(arg_min(raw_delta_fa_atr, row_idx), 6)
        ELSE round(sum(w * raw_delta_fa_atr) / sum(w), 6) END AS raw_delta_fa_atr,
      CASE WHEN sum(w) = 0 THEN round(arg_min(raw_delta_fa_rep, row_idx), 6)
        ELSE round(sum(w * raw_delta_fa_rep) / sum(w), 6) END AS raw_delta_fa_rep, round(any_value(log_kd), 6) AS log_kd
      FROM (SELECT *, CASE WHEN pdb LIKE '%7' THEN 0 ELSE rmsd_to_input END AS w FROM poses JOIN affinity USING (pdb)) GROUP BY pdb"""),
)
def weighted_collapse(spark, folder):
    weight = F.when(F.col("pdb").endswith("7"), 0.0).otherwise(F.col("rmsd_to_input"))
    rows = t.poses(spark, folder).withColumn("sample_weight", weight)
    rows = aggregate.join_affinity(rows, t.affinity(spark, folder))
    return rounded(
        aggregate.collapse_weighted(rows, ["raw_delta_fa_atr", "raw_delta_fa_rep"], "row_idx")
    )


@query(
    "A7_dispatch",
    with_views(t.POSES, t.AFFINITY, SUBSET, RANKED, body="""SELECT 'min' AS strategy, pdb, round(idelta_score, 6) AS idelta_score FROM ranked WHERE rn = 1
      UNION ALL SELECT 'mean_n', pdb, round(avg(idelta_score), 6) FROM ranked WHERE rn <= 10 GROUP BY pdb
      UNION ALL SELECT 'filtered_mean', pdb, round(avg(idelta_score), 6) FROM subset GROUP BY pdb"""),
)
def dispatch(spark, folder):
    rows = aggregate.keep_non_positive(aggregate.keep_refined_perturbed(t.poses(spark, folder)))
    parts = [
        aggregate.aggregate_per_pdb(rows, strategy=s).select(
            F.lit(s).alias("strategy"), "pdb", r6("idelta_score", "idelta_score")
        )
        for s in ("min", "mean_n", "filtered_mean")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "A8_pearson",
    # Under no correlation asin(r) has a density of cos to the power n - 3; Simpson's rule gives the tail.
    with_views(t.FEATURES, """m AS (SELECT corr(relax_idelta_score, -dG) AS r, count(*) AS n,
        count(*) FILTER (dG IS NOT NULL) AS k FROM features WHERE relax_idelta_score >= -100000)""",
        """tail AS (SELECT r, n, 2 * (pi() / 2 - asin(abs(r))) / 60000 *
        sum(CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END *
          pow(cos(asin(abs(r)) + (pi() / 2 - asin(abs(r))) * i / 20000), k - 3)) *
        exp(lgamma((k - 1) / 2.0) - lgamma((k - 2) / 2.0)) / sqrt(pi()) AS p
        FROM m, range(20001) s(i) GROUP BY r, n, k)""", body="""SELECT round(r, 6) AS r, n, round(p, 8) AS p_value,
      CASE WHEN p >= 1e-6 THEN printf('p-value = %.2e', p) ELSE 'p-value ≈ 0' END AS label FROM tail"""),
)
def pearson(spark, folder):
    """Correlation with its p-value and the label of a plot."""
    rows = t.features(spark, folder).where("relax_idelta_score >= -100000")
    found = rows.agg(
        metrics.pearson(F.col("relax_idelta_score"), -F.col("dG")).alias("r"), n_rows("n"), F.count("dG").alias("k")
    ).withColumn("p", metrics.p_value(F.col("r"), F.col("k")))
    return found.select(r6("r", "r"), "n", F.round("p", 8).alias("p_value"), metrics.label(F.col("p")).alias("label"))


@query(
    "A9_errors",
    with_views(t.FEATURES, body="""SELECT affinity_type, round(avg(abs(relax_idelta_score + dG)), 6) AS mae,
      round(sqrt(avg((relax_idelta_score + dG) * (relax_idelta_score + dG))), 6) AS rmse FROM features GROUP BY affinity_type"""),
)
def errors(spark, folder):
    x, y = F.col("relax_idelta_score"), -F.col("dG")
    return t.features(spark, folder).groupBy("affinity_type").agg(
        r6(metrics.mae(x, y), "mae"), r6(metrics.rmse(x, y), "rmse")
    )


@query(
    "A10_line_fit",
    with_views(t.FEATURES, body="""SELECT round(regr_slope(-dG, crystal_idelta_score), 6) AS slope,
      round(regr_intercept(-dG, crystal_idelta_score), 6) AS intercept, round(low - pad, 6) AS axis_low, round(high + pad, 6) AS axis_high
      FROM features, (SELECT low, high, (high - low) * 0.05::DOUBLE AS pad FROM (
        SELECT least(min(crystal_idelta_score), min(-dG)) AS low, greatest(max(crystal_idelta_score), max(-dG)) AS high FROM features))
      GROUP BY low, high, pad"""),
)
def line_fit(spark, folder):
    x, y = F.col("crystal_idelta_score"), -F.col("dG")
    fit = t.features(spark, folder).agg(*metrics.line_fit(x, y), *metrics.shared_limits(x, y))
    return rounded(fit, ())


@query(
    "A12_complete_ids",
    with_views(t.POSES, body="""SELECT pdb FROM poses GROUP BY pdb
      HAVING count(*) FILTER (WHERE type = 'apo_relax_docking_std') = 100"""),
)
def complete_ids(spark, folder):
    return progress.complete_ids(t.poses(spark, folder), 100)


PROGRESS = f"""labels AS (SELECT dataset, pdb, type FROM poses UNION ALL SELECT dataset, pdb, type FROM relax_poses),
progress AS (SELECT dataset, pdb, {', '.join(
    f"count(*) FILTER (WHERE type = '{s}') / {float(n)}::DOUBLE AS {s}" for s, n in STAGE_TARGETS.items())}
  FROM labels GROUP BY dataset, pdb)"""


def progress_rows(spark, folder):
    return progress.progress_vector(t.poses(spark, folder), t.relax_poses(spark, folder))


@query(
    "A13_progress",
    with_views(t.POSES, t.RELAX, PROGRESS, body=f"SELECT dataset, pdb, {', '.join(f'round({s}, 6) AS {s}' for s in STAGE_TARGETS)} FROM progress"),
)
def progress_vector(spark, folder):
    """From label counts that every appended batch keeps up, one batch here being sent twice."""
    table, counts = scratch_path(spark, "counted"), scratch_path(spark, "counts")
    keys = ["dataset", "pdb", "type"]
    rows = t.poses(spark, folder).select(*keys)
    batches = [rows.where("type LIKE '%perturb'"), rows.where("type NOT LIKE '%perturb'"), t.relax_poses(spark, folder).select(*keys)]
    for number in (0, 1, 1, 2):
        ingest.record_batch(batches[number], number, table, counts)
    return rounded(progress.progress_of_counts(ingest.read_counts(spark, counts)), ("dataset", "pdb"))


@query(
    "A14_stage_deficits",
    with_views(t.POSES, t.RELAX, PROGRESS, body=f"SELECT dataset, {', '.join(f'count(*) FILTER (WHERE {s} < 1) AS {s}' for s in STAGE_TARGETS)} FROM progress GROUP BY dataset"),
)
def stage_deficits(spark, folder):
    return progress.stage_deficits(progress_rows(spark, folder))


@query(
    "A14_incomplete_ids",
    with_views(t.POSES, t.RELAX, PROGRESS, body=f"SELECT dataset, pdb FROM progress WHERE {' OR '.join(f'{s} < 1' for s in STAGE_TARGETS)}"),
)
def incomplete_ids(spark, folder):
    return progress.incomplete_ids(progress_rows(spark, folder)).select("dataset", "pdb")


@query(
    "A15_run_status",
    with_views(t.RELAX, body="""SELECT pdb, CASE WHEN NOT relaxed THEN 'failed' WHEN NOT docked THEN 'half_finished' ELSE 'success' END AS status
      FROM (SELECT pdb, bool_or(relaxed) AS relaxed, bool_or(docked) AS docked FROM (
        SELECT l_partkey::VARCHAR AS pdb, false AS relaxed, l_returnflag = 'A' AND l_discount > 0.08 AS docked
          FROM lineitem
        UNION ALL SELECT o_custkey::VARCHAR, o_orderstatus = 'P', false FROM orders) GROUP BY pdb)"""),
)
def run_status(spark, folder):
    docked = (F.col("l_returnflag") == "A") & (F.col("l_discount") > 0.08)
    poses = t.read(spark, folder, "lineitem").select(
        F.col("l_partkey").cast("string").alias("pdb"),
        F.when(docked, "apo_relax_docking_perturb").otherwise("other").alias("type"),
    )
    relax = t.read(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("pdb"),
        F.when(F.col("o_orderstatus") == "P", "apo_relax").otherwise("relax").alias("type"),
    )
    return progress.run_status(poses, relax)


@query(
    "A16_histogram_2d",
    with_views(t.FEATURES, body="""SELECT least(floor((relax_idelta_score + 30) * 70 / 35), 69)::BIGINT AS x_bin,
      least(floor((-dG + 23) * 70 / 25), 69)::BIGINT AS y_bin, count(*) AS n FROM features
      WHERE relax_idelta_score BETWEEN -30 AND 5 AND -dG BETWEEN -23 AND 2 GROUP BY ALL"""),
)
def histogram_2d(spark, folder):
    return density.histogram_2d(t.features(spark, folder), F.col("relax_idelta_score"), -F.col("dG"))


@query(
    "A17_histogram",
    with_views(t.FEATURES, body="""SELECT least(floor((v - lo) * 40 / (hi - lo)), 39)::BIGINT AS bin, count(*) AS n
      FROM (SELECT crystal_idelta_score AS v FROM features WHERE crystal_idelta_score > 20),
        (SELECT min(crystal_idelta_score) AS lo, max(crystal_idelta_score) AS hi FROM features WHERE crystal_idelta_score > 20)
      GROUP BY 1"""),
)
def histogram(spark, folder):
    value = F.col("crystal_idelta_score")
    return density.histogram(t.features(spark, folder), value, 40, value > 20)


BOXED = ("crystal_idelta_score", "relax_idelta_score", "crystal_total_score", "relax_total_score", "qed")
BOXES = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, round(q1, 6) AS q1, round(q2, 6) AS median, round(q3, 6) AS q3,
      round(min({c}) FILTER (WHERE {c} >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low,
      round(max({c}) FILTER (WHERE {c} <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high
    FROM features, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2,
      quantile_cont({c}, 0.75) AS q3 FROM features) GROUP BY q1, q2, q3"""
    for c in BOXED
)


@query("A18_box_summary", with_views(t.FEATURES, body=BOXES))
def box_summary(spark, folder):
    return rounded(quantiles.box_summary(t.features(spark, folder), BOXED), ("column_name",))


@query(
    "A19_value_counts",
    with_views(t.FEATURES, body="SELECT affinity_type, count(*) AS n FROM features WHERE affinity_type IS NOT NULL GROUP BY 1"),
)
def value_counts(spark, folder):
    return filters.value_counts(t.features(spark, folder), "affinity_type")


def _sizes_sql(where, test):
    def one(s):
        train, val = f"count(*) FILTER (WHERE {s} = 'train')", f"count(*) FILTER (WHERE {s} = 'val')"
        if s == "split_c":
            val = f"trunc({train} * (1 - 0.9::DOUBLE))::BIGINT"
            train = f"trunc({train} * 0.9::DOUBLE)::BIGINT"
        return f"""SELECT '{s}' AS split, {train} AS train, {val} AS val,
          count(*) FILTER (WHERE {s} = 'test' AND {test}) AS test FROM features WHERE {where}"""

    return " UNION ALL ".join(one(s) for s in t.SPLIT_COLUMNS)


@query("A20_split_sizes", with_views(t.FEATURES, body=_sizes_sql("true", "true")))
def split_sizes(spark, folder):
    return filters.split_sizes(t.features(spark, folder), t.SPLIT_COLUMNS, "split_c")


SELECTED = ("vague_measures", "covalent", "fully_relaxed", "has_rare_elem", "rmsd_RelToCry", "relax_idelta")


@query(
    "A21_split_sizes_filtered",
    with_views(t.FEATURES, body=_sizes_sql(" AND ".join(t.KEEPS[s] for s in SELECTED), t.KEEPS["affinity_type"])),
)
def split_sizes_filtered(spark, folder):
    rows = filters.apply_filters(t.features(spark, folder), filters.feature_filters(), SELECTED)
    return filters.split_sizes(rows, t.SPLIT_COLUMNS, "split_c", features.not_ic50())


PREDICTORS = {
    "crystal_idelta": "crystal_idelta_score",
    "relax_idelta": "relax_idelta_score",
    "real_delta": "relax_total_score - ligaway_total_score",
}
METRICS = " UNION ALL ".join(
    f"""SELECT '{s}' AS split, '{n}' AS predictor, round(sqrt(avg(pow({e} + dG, 2))), 6) AS rmse,
      round(avg(abs({e} + dG)), 6) AS mae, round(corr({e}, -dG), 6) AS pcc FROM features
    WHERE {s} = 'test' AND {t.KEEPS['relax_idelta']}"""
    for s in t.SPLIT_COLUMNS
    for n, e in PREDICTORS.items()
)


@query("A22_split_metrics", with_views(t.FEATURES, body=METRICS))
def split_metrics(spark, folder):
    rows = filters.apply_filters(t.features(spark, folder), filters.feature_filters(), ["relax_idelta"])
    predictors = {n: F.expr(e) for n, e in PREDICTORS.items()}
    found = features.split_metrics(rows, t.SPLIT_COLUMNS, predictors, -F.col("dG"))
    return rounded(found, ("split", "predictor"))


@query(
    "A23_distinct_counts",
    with_views(t.POSES, body="""SELECT count(DISTINCT pdb) AS n_pdbs, array_to_string(list_sort(list_distinct(list(type))), ',') AS types,
      count(DISTINCT pdb) FILTER (WHERE total_score <= 0 AND idelta_score <= 0) AS n_surviving FROM poses"""),
)
def distinct_counts(spark, folder):
    survives = (F.col("total_score") <= 0) & (F.col("idelta_score") <= 0)
    per_pdb = t.poses(spark, folder).groupBy("pdb").agg(
        F.bool_or(survives).alias("ok"), F.collect_set("type").alias("types")
    )
    return per_pdb.agg(
        n_rows("n_pdbs"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))), ",").alias("types"),
        F.count_if("ok").alias("n_surviving"),
    )


CONTACT_VIEWS = (t.ATOMS, t.LIGAND, t.HITS, t.BLOCKS, t.CONTACTS)


@query("A24_protein_size", with_views(*CONTACT_VIEWS, body="SELECT pdb, size FROM chain_sizes"))
def protein_size(spark, folder):
    return contact_parts(spark, folder).sizes


@query(
    "A25_residue_frequency",
    with_views(*CONTACT_VIEWS, body="""SELECT role, name, count(*) AS n_pdbs FROM contacts
      WHERE role IN ('modified', 'co_ligand') GROUP BY ALL HAVING count(*) > 14"""),
)
def residue_frequency(spark, folder):
    found = contact_parts(spark, folder).contacts
    parts = [
        contacts.residue_frequency(found, role, 14).select(F.lit(role).alias("role"), "name", "n_pdbs")
        for role in ("modified", "co_ligand")
    ]
    return parts[0].unionByName(parts[1])


@query("A26_contact_sets", with_views(*CONTACT_VIEWS, body="SELECT pdb, role, name, atom_no FROM contacts"))
def contact_sets(spark, folder):
    return contact_parts(spark, folder).contacts


ALLOWED_SQL = " OR ".join(f"contains(s, '{p}')" for p in ALLOWED_FLAGS)


@query(
    "A27_unknown_flags",
    with_views(t.ANNOTATIONS, REASONED, body=f"""SELECT s AS flag, count(*) AS n FROM (
      SELECT unnest(string_split(f, ', ')) AS s FROM (SELECT unnest(low) AS f FROM reasoned WHERE reason = 'kept'))
      WHERE s <> '' AND NOT ({ALLOWED_SQL}) GROUP BY s"""),
)
def unknown_flags(spark, folder):
    return annotations.unknown_flag_tally(annotated(spark, folder).where("reason = 'kept'"))


@query(
    "A28_removal_counts",
    with_views(t.ANNOTATIONS, REASONED, LIGAND_ATOM_ROWS, body="""SELECT 'index' AS stage, reason, count(*) AS n FROM reasoned GROUP BY reason
      UNION ALL SELECT 'ligand', reason, count(*) FROM ligand_reasons GROUP BY reason"""),
)
def removal_counts(spark, folder):
    stages = {"index": annotated(spark, folder), "ligand": ligand_profile_rows(spark, folder)}
    parts = [
        filters.reason_counts(df).select(F.lit(s).alias("stage"), "reason", "n") for s, df in stages.items()
    ]
    return parts[0].unionByName(parts[1])


@query(
    "A29_ligand_audit",
    with_views(PROBE, body="""SELECT count(*) AS n, count(*) FILTER (WHERE has_hydrogen) AS with_hydrogen,
      count(*) FILTER (WHERE has_aromatic) AS with_aromatic FROM probe"""),
)
def ligand_audit(spark, folder):
    return ligand_probe(ligand_file_lines(spark, folder)).agg(
        n_rows("n"),
        F.count_if("has_hydrogen").alias("with_hydrogen"),
        F.count_if("has_aromatic").alias("with_aromatic"),
    )


@query(
    "A30_size_report",
    with_views(*CONTACT_VIEWS, body="""SELECT count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM contacts c
        WHERE c.pdb = s.pdb AND c.role = 'chain')) AS without_chain, min(size) AS min_size,
      count(*) FILTER (WHERE size > 1000) AS above_1000, count(*) FILTER (WHERE size > 1500) AS above_1500 FROM chain_sizes s"""),
)
def size_report(spark, folder):
    parts = contact_parts(spark, folder)
    return contacts.size_report(parts.sizes, parts.contacts)


@query(
    "A31_run_summary",
    with_views(t.POSES, body="""SELECT pdb, type, round(min(total_score), 6) AS best_score, round(min(idelta_score), 6) AS best_idelta,
      round(min(rmsd_to_crystal), 6) AS best_rmsd_to_crystal, round(min(rmsd_to_input), 6) AS best_rmsd_to_input,
      round(avg(prepare_time / 97), 6) AS mean_reduction FROM poses GROUP BY pdb, type"""),
)
def run_summary(spark, folder):
    rows = t.poses(spark, folder).withColumn("saved_share", F.col("prepare_time") / 97)
    return rounded(progress.run_summary(rows), ("pdb", "type"))


@query(
    "A32_storage_report",
    with_views(t.POSES, """cells AS (
        SELECT dataset, 'type' AS column_name, sum(strlen(type))::BIGINT AS bytes FROM poses GROUP BY dataset
        UNION ALL SELECT dataset, 'total_score', count(total_score) * 8 FROM poses GROUP BY dataset
        UNION ALL SELECT dataset, 'raw_delta_hbond_sc', count(raw_delta_hbond_sc) * 8 FROM poses GROUP BY dataset)""",
        body="""SELECT coalesce(dataset, 'TOTAL') AS dataset, coalesce(column_name, 'TOTAL') AS column_name,
      sum(bytes)::BIGINT AS bytes FROM cells GROUP BY ROLLUP (dataset, column_name)"""),
)
def storage_report(spark, folder):
    columns = ["type", "total_score", "raw_delta_hbond_sc"]
    return progress.storage_report(t.poses(spark, folder), columns).drop("size_text")


@query(
    "A33_cluster_statistics",
    """WITH sizes AS (SELECT user_id, event_type, count(*) AS size FROM events GROUP BY ALL),
      per AS (SELECT user_id, count(*) AS k FROM sizes GROUP BY 1)
      SELECT (SELECT count(*) FROM per) AS n_pdbs, count(*) AS n_clusters, sum(size)::BIGINT AS n_poses,
        (SELECT round(avg(k), 6) FROM per) AS mean_clusters_per_pdb, (SELECT quantile_cont(k, 0.5) FROM per) AS median_clusters_per_pdb,
        (SELECT max(k) FROM per) AS max_clusters_per_pdb, round(avg(size), 6) AS mean_cluster_size,
        quantile_cont(size, 0.5) AS median_cluster_size, max(size) AS max_cluster_size,
        count(*) FILTER (WHERE size = 1) AS n_singletons, round(count(*) FILTER (WHERE size = 1) / count(*), 6) AS singleton_share
      FROM sizes""",
)
def cluster_statistics(spark, folder):
    members = t.read(spark, folder, "events").select(
        F.col("user_id").alias("pdb"), F.col("event_type").alias("cluster_id")
    )
    stats = clustering.cluster_statistics(members)
    shares = ("mean_clusters_per_pdb", "mean_cluster_size", "singleton_share")
    return stats.withColumns({c: F.round(c, 6) for c in shares})


@query(
    "A35_line_counts",
    """SELECT conv_id, len(string_split(text, ' ')) AS base_lines,
      len(list_filter(string_split(text, ' '), lambda w: length(w) = 3 AND reverse(w) <> w)) AS delta_entries
      FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1""",
)
def line_counts(spark, folder):
    first = first_per_key(word_pairs(spark, folder), ["conv_id"], [F.col("turn")])
    changes = delta.changed_lines(F.col("base"), F.col("new"))
    return first.select(
        "conv_id",
        F.size("base").cast("long").alias("base_lines"),
        F.size(changes).cast("long").alias("delta_entries"),
    )
