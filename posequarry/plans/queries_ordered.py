"""Row numbering, sorting, top rows and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from posequarry.fixed_values import SCORE_WEIGHTS
from posequarry.functions.missing import fails
from posequarry.operators import contacts, filters, fitting, logs, ordering
from posequarry.plans import driver_tables as t
from posequarry.plans import experiment
from posequarry.plans.catalog import n_rows, query, r6, with_views
from posequarry.plans.queries_columns import CLASSES, ENGINE_SQL
from posequarry.plans.queries_sources import SUBSET
from posequarry.sources.store import filtered_subset


@query(
    "W1_sequence_ids",
    with_views(t.POSES, body="""SELECT pdb, type, row_idx,
      row_number() OVER (PARTITION BY pdb, type ORDER BY row_idx) - 1 AS type_seq_id FROM poses"""),
)
def sequence_ids(spark, folder):
    rows = t.poses(spark, folder).select("pdb", "type", "row_idx")
    return ordering.sequence_ids(rows, ["pdb", "type"], ["row_idx"])


@query(
    "W2_ter_blocks",
    with_views(t.ATOMS, t.BLOCKS, body="SELECT pdb, line_no, ter_block FROM blocks"),
)
def ter_blocks(spark, folder):
    return contacts.with_ter_blocks(t.structure_lines(spark, folder)).select("pdb", "line_no", "ter_block")


@query(
    "W3_last_row",
    with_views(t.POSES, body="""SELECT pdb, row_idx, round(idelta_score, 6) AS idelta_score, round(total_score, 6) AS total_score
      FROM poses QUALIFY row_number() OVER (PARTITION BY pdb ORDER BY row_idx DESC) = 1"""),
)
def last_row(spark, folder):
    rows = ordering.first_per_key(t.poses(spark, folder), ["pdb"], [F.col("row_idx").desc()])
    return rows.select("pdb", "row_idx", r6("idelta_score", "idelta_score"), r6("total_score", "total_score"))


@query(
    "W4_first_per_key",
    """SELECT doc_id, source, lang, n_chars FROM documents
      QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) = 1""",
)
def first_per_key(spark, folder):
    rows = t.read(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars")
    return ordering.first_per_key(rows, ["source", "lang"], [F.col("n_chars").desc(), F.col("doc_id")])


@query(
    "W5_n_smallest",
    with_views(t.POSES, body="""SELECT pdb, rank, row_idx, round(idelta_score, 6) AS idelta_score FROM (
      SELECT *, row_number() OVER (PARTITION BY pdb ORDER BY idelta_score, row_idx) AS rank FROM poses) WHERE rank <= 10"""),
)
def n_smallest(spark, folder):
    rows = t.poses(spark, folder).select("pdb", "row_idx", "idelta_score")
    order = [F.col("idelta_score").asc_nulls_last(), F.col("row_idx")]
    ranked = ordering.n_smallest(rows, ["pdb"], order, 10, "rank")
    return ranked.select("pdb", "rank", "row_idx", r6("idelta_score", "idelta_score"))


@query(
    "W6_first_match",
    with_views(t.LOG_LINES, body="""SELECT job, min(line_no) FILTER (WHERE contains(line, 'que ')) AS line_no,
      count(*) FILTER (WHERE contains(line, 'que ')) AS hits FROM log_lines GROUP BY job"""),
)
def first_match(spark, folder):
    hit = F.col("line").contains("que ")
    return t.log_lines(spark, folder).groupBy("job").agg(
        F.min(F.when(hit, F.col("line_no"))).alias("line_no"), F.count_if(hit).alias("hits")
    )


# -- sorting -----------------------------------------------------------------


SLOPES = """slopes AS (
  SELECT term, slope AS weight, original_weight FROM (
    SELECT """ + ", ".join(
    f"regr_slope(idelta_score, raw_delta_{x}) AS {x}" for x in t.INFORMATIVE
) + """ FROM subset) s, LATERAL (VALUES """ + ", ".join(
    f"('{x}', s.{x}, {w}::DOUBLE)"
    for x, w in zip(t.INFORMATIVE, (0.8, 0.4, 0.6, 0.42, 0.8, 1.3, 1.3), strict=True)
) + """) v(term, slope, original_weight))"""


def slope_weights(spark, folder):
    """A weight per term from the data: slope of the score on the term."""
    rows = filtered_subset(t.poses(spark, folder), t.affinity(spark, folder))
    slopes = rows.agg(*[F.regr_slope("idelta_score", f"raw_delta_{x}").alias(x) for x in t.INFORMATIVE])
    cells = F.array(
        *[
            F.struct(
                F.lit("all").alias("config"),
                F.lit(i).alias("position"),
                F.lit(f"raw_delta_{x}").alias("energy_term"),
                F.col(x).alias("weight"),
                F.lit(SCORE_WEIGHTS[x]).alias("original_weight"),
            )
            for i, x in enumerate(t.INFORMATIVE)
        ]
    )
    return slopes.select(F.inline(cells))


@query(
    "T1_sorted_weights",
    with_views(t.POSES, t.AFFINITY, SUBSET, SLOPES, body="""SELECT row_number() OVER (ORDER BY abs(weight) DESC) AS place,
      'raw_delta_' || term AS energy_term, round(weight, 6) AS weight FROM slopes"""),
)
def sorted_weights(spark, folder):
    ranked = fitting.sorted_weights(slope_weights(spark, folder))
    place = F.row_number().over(Window.partitionBy("config").orderBy(F.abs("weight").desc()))
    return ranked.select(place.alias("place"), "energy_term", r6("weight", "weight"))


@query(
    "T2_top_terms",
    with_views(t.POSES, t.AFFINITY, SUBSET, SLOPES, body="""SELECT term, round(weight, 6) AS weight, original_weight FROM slopes
      ORDER BY abs(original_weight) DESC, term LIMIT 15"""),
)
def top_terms(spark, folder):
    rows = experiment.top_terms(slope_weights(spark, folder), "all", 15)
    return rows.select("term", r6("weight", "weight"), "original_weight")


@query(
    "T3_weight_changes",
    with_views(t.POSES, t.AFFINITY, SUBSET, SLOPES, body="""SELECT 'raw_delta_' || term AS energy_term, round(weight, 6) AS new, original_weight AS old,
      round(weight - original_weight, 6) AS diff, round(weight / original_weight, 6) AS quot FROM slopes"""),
)
def weight_changes(spark, folder):
    rows = experiment.weight_changes(slope_weights(spark, folder))
    return rows.select("energy_term", r6("new", "new"), "old", r6("diff", "diff"), r6("quot", "quot"))


@query(
    "T4_head_report",
    with_views(t.POSES, t.AFFINITY, SUBSET, body="""SELECT pdb, type, round(total_score, 6) AS total_score,
      round(idelta_score, 6) AS idelta_score, round(log_kd, 6) AS log_kd FROM subset ORDER BY pdb, row_idx LIMIT 10"""),
)
def head_report(spark, folder):
    rows = filtered_subset(t.poses(spark, folder), t.affinity(spark, folder))
    head = rows.orderBy("pdb", "row_idx").limit(10)
    return head.select("pdb", "type", *[r6(c, c) for c in ("total_score", "idelta_score", "log_kd")])


@query(
    "T5_sorted_counts",
    with_views(t.LOG_LINES, body="SELECT string_split(job, '_')[1] AS family, count(*) AS n FROM log_lines GROUP BY 1"),
)
def sorted_counts(spark, folder):
    rows = t.log_lines(spark, folder).withColumn("family", F.substring_index("job", "_", 1))
    return filters.value_counts(rows, "family")


# -- set operations ------------------------------------------------------------


@query(
    "U1_union_all",
    with_views(t.POSES, t.RELAX, body="""SELECT type, count(*) AS n, round(sum(total_score), 6) AS total FROM (
      SELECT type, total_score FROM poses UNION ALL SELECT type, total_score FROM relax_poses) GROUP BY type"""),
)
def union_all(spark, folder):
    columns = ["type", "total_score"]
    rows = t.poses(spark, folder).select(*columns).unionByName(t.relax_poses(spark, folder).select(*columns))
    return rows.groupBy("type").agg(n_rows("n"), r6(F.sum("total_score"), "total"))


CLASS_NAMES = ("index_error", "oserror", "engine_error", "oom", "keyerror")
ANY = f"(index_error OR oserror OR oom OR keyerror OR {ENGINE_SQL})"


@query("U2_class_union", with_views(t.LOG_LINES, CLASSES, body=f"SELECT job FROM classes WHERE {ANY}"))
def class_union(spark, folder):
    return logs.jobs_in(logs.classify_jobs(t.log_lines(spark, folder), t.LOG_WORDS), CLASS_NAMES)


@query("U3_unclassified", with_views(t.LOG_LINES, CLASSES, body=f"SELECT job FROM classes WHERE NOT {ANY}"))
def unclassified(spark, folder):
    jobs = logs.classify_jobs(t.log_lines(spark, folder), t.LOG_WORDS)
    return logs.unclassified_jobs(jobs, CLASS_NAMES)


@query(
    "U4_intersection",
    with_views(t.FEATURES, body=f"SELECT pdb FROM features WHERE NOT {t.KEEPS['qed']} INTERSECT SELECT pdb FROM features WHERE NOT {t.KEEPS['affinity_type']}"),
)
def intersection(spark, folder):
    rows, keep = t.features(spark, folder), filters.feature_filters()
    removed = [rows.where(fails(keep[n])).select("pdb") for n in ("qed", "affinity_type")]
    return removed[0].intersect(removed[1])


@query("U5_distinct_keys", with_views(t.POSES, body="SELECT DISTINCT dataset, pdb FROM poses"))
def distinct_keys(spark, folder):
    return t.poses(spark, folder).select("dataset", "pdb").distinct()


@query(
    "U6_concatenation",
    with_views(t.FEATURES, body="""SELECT pdb, count(*) AS copies FROM (SELECT pdb FROM features WHERE relax_total_score > 150
      UNION ALL SELECT pdb FROM features WHERE crystal_idelta_score > 20) GROUP BY pdb"""),
)
def concatenation(spark, folder):
    rows = t.features(spark, folder)
    both = rows.where("relax_total_score > 150").select("pdb").union(
        rows.where("crystal_idelta_score > 20").select("pdb")
    )
    return both.groupBy("pdb").agg(n_rows("copies"))
