"""Joins, contacts and state pairs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posequarry.fixed_values import STAGE_TARGETS
from posequarry.operators import aggregate, contacts, density, filters, splits, structure
from posequarry.operators.progress import resume_plan
from posequarry.plans import driver_tables as t
from posequarry.plans import queries_models
from posequarry.plans.catalog import n_rows, query, r6, with_views
from posequarry.plans.queries_sources import SUBSET
from posequarry.session import materialize
from posequarry.sources.splits import membership
from posequarry.sources.store import filtered_subset


class ContactParts(NamedTuple):
    atoms: DataFrame
    hits: DataFrame
    contacts: DataFrame
    sizes: DataFrame


def contact_parts(spark, folder) -> ContactParts:
    """Contacts of all complexes; what several branches read is checkpointed."""
    rows = contacts.with_ter_blocks(t.structure_rows(spark, folder), is_end=F.col("record") == "TER")
    atoms = materialize(rows.where("record <> 'TER'"))
    hits = contacts.within_radius(atoms, t.ligand_points(spark, folder))
    table = materialize(contacts.contact_table(atoms, hits))
    return ContactParts(atoms, hits, table, contacts.protein_sizes(atoms, table))


@query(
    "J1_affinity_join",
    with_views(t.POSES, t.AFFINITY, body="""SELECT pdb, count(*) AS n, round(avg(log_kd), 6) AS log_kd,
      round(sum(idelta_score), 6) AS idelta FROM poses JOIN affinity USING (pdb) GROUP BY pdb"""),
)
def affinity_join(spark, folder):
    joined = aggregate.join_affinity(t.poses(spark, folder), t.affinity(spark, folder))
    return joined.groupBy("pdb").agg(
        n_rows("n"), r6(F.avg("log_kd"), "log_kd"), r6(F.sum("idelta_score"), "idelta")
    )


@query(
    "J2_join_kd_columns",
    with_views(t.POSES, t.AFFINITY, SUBSET, body="""SELECT a.pdb, round(idelta, 6) AS idelta, round(k.log_kd, 6) AS log_kd
      FROM (SELECT pdb, avg(idelta_score) AS idelta FROM subset GROUP BY pdb) a
      JOIN (SELECT DISTINCT pdb, log_kd FROM subset) k ON a.pdb = k.pdb"""),
)
def join_kd(spark, folder):
    subset = filtered_subset(t.poses(spark, folder), t.affinity(spark, folder))
    means = subset.groupBy("pdb").agg(F.avg("idelta_score").alias("idelta"))
    joined = aggregate.join_kd_columns(means, subset)
    return joined.select("pdb", r6("idelta", "idelta"), r6("log_kd", "log_kd"))


MEMBERSHIP = """membership AS (
  SELECT 'first' AS source, user_id::VARCHAR AS pdb, event_type AS split,
    CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END AS priority
  FROM events
  UNION ALL SELECT 'second', (user_id * 3)::VARCHAR, event_type,
    CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'error' THEN 4 ELSE 5 END FROM events)"""


def memberships(spark, folder):
    events = t.read(spark, folder, "events")
    first = events.select(F.col("user_id").cast("string").alias("pdb"), "event_type")
    second = events.select((F.col("user_id") * 3).cast("string").alias("pdb"), "event_type")
    kinds = [("click", 1), ("view", 2), ("error", 3), ("purchase", 4), ("signup", 5)]
    rows = [membership(first.where(F.col("event_type") == k), "first", k, p) for k, p in kinds]
    rows += [
        membership(second.where(F.col("event_type") == k), "second", k, p)
        for k, p in (("signup", 1), ("view", 2), ("click", 3), ("error", 4), ("purchase", 5))
    ]
    union = rows[0]
    for more in rows[1:]:
        union = union.unionByName(more)
    return union


def customer_ids(spark, folder):
    return t.read(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("pdb"))


@query(
    "J3_split_precedence",
    with_views(MEMBERSHIP, body="""SELECT c_custkey::VARCHAR AS pdb, a.split AS first, b.split AS second FROM customer
      LEFT JOIN (SELECT pdb, arg_min(split, priority) AS split FROM membership WHERE source = 'first' GROUP BY pdb) a
        ON a.pdb = c_custkey::VARCHAR
      LEFT JOIN (SELECT pdb, arg_min(split, priority) AS split FROM membership WHERE source = 'second' GROUP BY pdb) b
        ON b.pdb = c_custkey::VARCHAR"""),
)
def split_precedence(spark, folder):
    return splits.assign_splits(customer_ids(spark, folder), memberships(spark, folder), ["first", "second"])


@query(
    "J4_required_lookup",
    """SELECT o_orderkey, c_nationkey, round(c_acctbal, 6) AS c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def required_lookup(spark, folder):
    rows = t.read(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    found = splits.required_lookup(
        rows, t.read(spark, folder, "customer"), "c_custkey", ["c_nationkey", "c_acctbal"]
    )
    return found.select("o_orderkey", "c_nationkey", r6("c_acctbal", "c_acctbal"))


@query(
    "J5_members",
    with_views(MEMBERSHIP, body="SELECT c_custkey::VARCHAR AS pdb FROM customer WHERE c_custkey::VARCHAR IN (SELECT pdb FROM membership)"),
)
def members(spark, folder):
    return splits.members_of(customer_ids(spark, folder), memberships(spark, folder))


@query(
    "J6_without_ids",
    with_views(MEMBERSHIP, body="""SELECT c_custkey::VARCHAR AS pdb FROM customer WHERE c_custkey::VARCHAR NOT IN (
      SELECT pdb FROM membership WHERE source = 'first' AND pdb NOT IN (SELECT pdb FROM membership WHERE source = 'second'))"""),
)
def without_ids(spark, folder):
    rows = memberships(spark, folder)
    return splits.without_ids(
        customer_ids(spark, folder), rows.where("source = 'first'"), rows.where("source = 'second'")
    )


@query("J7_radius_join", with_views(t.ATOMS, t.LIGAND, t.HITS, body="SELECT pdb, line_no FROM hits"))
def radius_join(spark, folder):
    atoms = t.structure_atoms(spark, folder)
    return contacts.within_radius(atoms, t.ligand_points(spark, folder)).select("pdb", "line_no")


@query(
    "J8_sequence_mapping",
    with_views(t.POSES, body="""SELECT r.pdb, r.type, r.type_seq_id, s.row_idx, s.row_idx IS NOT NULL AS valid FROM (
      SELECT printf('%04d', o_custkey // 15) AS pdb, CASE o_orderstatus WHEN 'F' THEN 'crystal' WHEN 'O' THEN 'relax'
        ELSE 'apo_relax' END || '_docking_std' AS type, o_orderkey % 200 AS type_seq_id FROM orders) r
      LEFT JOIN (SELECT pdb, type, row_idx, row_number() OVER (PARTITION BY pdb, type ORDER BY row_idx) - 1 AS type_seq_id
        FROM poses) s ON r.pdb = s.pdb AND r.type = s.type AND r.type_seq_id = s.type_seq_id"""),
)
def sequence_mapping(spark, folder):
    requested = t.relax_poses(spark, folder).select(
        "pdb",
        F.concat("type", F.lit("_docking_std")).alias("type"),
        (F.col("row_idx") % 200).alias("type_seq_id"),
    )
    return structure.map_sequence_ids(requested, t.poses(spark, folder))


STATE_TERMS = ("total_score", "raw_fa_atr", "raw_fa_rep", "raw_fa_sol")


@query(
    "J9_state_difference",
    with_views(t.RELAX, """firsts AS (SELECT * FROM relax_poses WHERE type <> 'crystal'
      QUALIFY row_number() OVER (PARTITION BY pdb, type ORDER BY row_idx) = 1)""",
        body=f"""SELECT b.pdb, {', '.join(f'round(b.{c} - f.{c}, 6) AS {c}' for c in STATE_TERMS)}
      FROM (SELECT * FROM firsts WHERE type = 'relax') b JOIN (SELECT * FROM firsts WHERE type = 'apo_relax') f ON b.pdb = f.pdb"""),
)
def state_difference(spark, folder):
    rows = structure.state_difference(t.relax_poses(spark, folder), STATE_TERMS)
    return rows.where(F.col("total_score").isNotNull()).select("pdb", *[r6(c, c) for c in STATE_TERMS])


def _base_lines():
    """Base text of a prepared pose: a few numbered lines with its scores."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(9)),
        lambda i: F.concat_ws(" ", i, F.col("row_idx") % 1000, (F.col("row_idx") * (i + 1)) % 97),
    )


@query(
    "J10_docked_text",
    with_views(t.POSES, t.RELAX, """base AS (SELECT pdb, type AS start, row_idx AS base_row FROM relax_poses
      QUALIFY row_number() OVER (PARTITION BY pdb, type ORDER BY total_score, row_idx) = 1)""", body="""
      SELECT p.pdb, p.row_idx, array_to_string(list_transform(range(10), lambda i: CASE WHEN i = p.row_idx % 10 THEN
        'new ' || (p.row_idx % 7)::VARCHAR ELSE i::VARCHAR || ' ' || (b.base_row % 1000)::VARCHAR || ' ' ||
        ((b.base_row * (i + 1)) % 97)::VARCHAR END), chr(10)) AS text
      FROM poses p JOIN base b ON p.pdb = b.pdb AND b.start = regexp_replace(p.type, '_docking_.*$', '')"""),
)
def docked_text(spark, folder):
    relax = t.relax_poses(spark, folder).select(
        "pdb", "type", "row_idx", "total_score", _base_lines().alias("lines")
    )
    k = F.col("row_idx")
    poses = t.poses(spark, folder).select(
        "pdb",
        "type",
        "row_idx",
        F.create_map((k % 10).cast("int"), F.concat(F.lit("new "), (k % 7).cast("string"))).alias("delta"),
    )
    joined = structure.docked_text(poses, relax)
    return joined.select("pdb", "row_idx", F.array_join("lines", "\n").alias("text"))


OVERLAP = " UNION ALL ".join(
    f"SELECT '{a}' AS filter_a, '{b}' AS filter_b, count(*) FILTER (WHERE NOT {p} AND NOT {q}) AS both_removed FROM features"
    for a, p in t.KEEPS.items()
    for b, q in t.KEEPS.items()
)


@query("J11_removal_overlap", with_views(t.FEATURES, body=OVERLAP))
def removal_overlap(spark, folder):
    return filters.removal_overlap(t.features(spark, folder), filters.feature_filters())


@query(
    "J12_experiment_grid",
    with_views(*queries_models.WHOLE_GRID_VIEWS, body="""SELECT aggregation, term_selection, count(*) AS n_complexes,
      round(avg(agg_score), 6) AS agg_score FROM scatter GROUP BY ALL"""),
)
def experiment_grid(spark, folder):
    """All sixteen cells, each with the complexes it holds and their mean score."""
    cells = queries_models.whole_grid(spark, folder).scatter().groupBy("aggregation", "term_selection")
    return cells.agg(n_rows("n_complexes"), r6(F.avg("agg_score"), "agg_score"))


@query(
    "J13_kernel_density",
    with_views(t.POSES, t.AFFINITY, """pts AS (SELECT pdb, log_kd AS x, idelta AS y FROM affinity JOIN
        (SELECT pdb, avg(idelta_score) AS idelta FROM poses GROUP BY pdb) m USING (pdb)),
      m AS (SELECT count(*) AS n, pow(count(*), -1.0::DOUBLE / 6) AS f, var_samp(x) AS vx, var_samp(y) AS vy,
        covar_samp(x, y) AS cxy FROM pts),
      c AS (SELECT n, vx * f * f AS a, cxy * f * f AS b, vy * f * f AS d FROM m)""", body="""
      SELECT p.pdb, round(sum(exp(-0.5::DOUBLE * (d * (p.x - q.x) * (p.x - q.x) - 2 * b * (p.x - q.x) * (p.y - q.y)
        + a * (p.y - q.y) * (p.y - q.y)) / (a * d - b * b))) / any_value(n * 2 * pi() * sqrt(a * d - b * b)), 6) AS density
      FROM pts p, pts q, c GROUP BY p.pdb"""),
)
def kernel_density(spark, folder):
    means = t.poses(spark, folder).groupBy("pdb").agg(F.avg("idelta_score").alias("y"))
    points = means.join(t.affinity(spark, folder), "pdb")
    drawn = density.kernel_density(points, "log_kd", "y").select("pdb", r6("density", "density"))
    # Densest points last, so that a plot draws them on top.
    return drawn.orderBy("density", "pdb")


@query(
    "A34_resume_plan",
    with_views(t.POSES, """targets AS (SELECT * FROM (VALUES ('crystal_docking_perturb', 100), ('crystal_docking_std', 100),
        ('relax_docking_perturb', 100), ('relax_docking_std', 100), ('apo_relax_docking_perturb', 100),
        ('apo_relax_docking_std', 100)) v(stage, target))""", body="""
      SELECT w.pdb, stage, coalesce(done, 0) AS done, greatest(target - coalesce(done, 0), 0) AS remaining
      FROM (SELECT printf('%04d', s_suppkey + 5) AS pdb FROM supplier) w CROSS JOIN targets LEFT JOIN
        (SELECT pdb, type AS stage, count(*) AS done FROM poses GROUP BY ALL) c USING (pdb, stage)"""),
)
def resume(spark, folder):
    work = t.read(spark, folder, "supplier").select(t.pdb_id(F.col("s_suppkey") + 5).alias("pdb"))
    stages = {s: 100 for s in STAGE_TARGETS if "docking" in s}
    return resume_plan(work, t.poses(spark, folder), stages)
