"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from posequarry.fixed_values import (
    COMMON_LIGAND_ELEMENTS,
    COMMON_RECEPTOR_ELEMENTS,
    SCORE_WEIGHTS,
)
from posequarry.functions import affinity as aff
from posequarry.functions import delta, terms, text
from posequarry.functions.missing import holds
from posequarry.operators import aggregate, annotations, contacts, filters, logs
from posequarry.operators.quantiles import long_form
from posequarry.plans import driver_tables as t
from posequarry.plans import experiment
from posequarry.plans.catalog import n_rows, query, r6, with_views
from posequarry.plans.queries_joins import contact_parts
from posequarry.sources import store
from posequarry.sources.index import parse_annotations


# -- affinity ---------------------------------------------------------------

SPLIT_MEASURE = """parts AS (
  SELECT pdb, measure, p_size, p_partkey % 6 AS u,
    CASE WHEN measure LIKE '%>=%' THEN '>=' WHEN measure LIKE '%<=%' THEN '<=' WHEN measure LIKE '%=%' THEN '='
      WHEN measure LIKE '%~%' THEN '~' WHEN measure LIKE '%>%' THEN '>' ELSE '<' END AS delim FROM measures)"""


@query(
    "P1_exact_kd",
    with_views(t.MEASURES, body=r"""SELECT pdb, (p_size + 1)::DOUBLE AS value,
      right(measure, 2) AS unit FROM measures WHERE regexp_matches(measure, '^Kd=[0-9]+[munpf]M$')"""),
)
def exact_kd(spark, folder):
    rows = t.measures(spark, folder).select(
        "pdb",
        aff.exact_kd_value(F.col("measure")).alias("value"),
        aff.exact_kd_unit(F.col("measure")).alias("unit"),
    )
    return rows.where(F.col("value").isNotNull())


@query(
    "P2_molar_factor",
    with_views(t.MEASURES, body="""SELECT right(measure, 2) AS unit, CASE right(measure, 2) WHEN 'mM' THEN 1e-3
      WHEN 'uM' THEN 1e-6 WHEN 'nM' THEN 1e-9 WHEN 'pM' THEN 1e-12 WHEN 'fM' THEN 1e-15 END AS factor,
      count(*) AS n FROM measures GROUP BY ALL"""),
)
def molar_factor(spark, folder):
    unit = F.right("measure", F.lit(2))
    rows = t.measures(spark, folder).select(unit.alias("unit"), aff.molar_factor(unit).alias("factor"))
    return rows.groupBy("unit", "factor").agg(n_rows("n"))


@query(
    "P3_log_kd",
    with_views(t.MEASURES, body="""SELECT pdb, round(log10((p_size + 1) * CASE right(measure, 2) WHEN 'mM' THEN 1e-3
      WHEN 'uM' THEN 1e-6 WHEN 'nM' THEN 1e-9 WHEN 'pM' THEN 1e-12 WHEN 'fM' THEN 1e-15 END), 6) AS log_kd
      FROM measures WHERE measure LIKE 'Kd=%' AND measure NOT LIKE '%XM'"""),
)
def log_kd(spark, folder):
    molar = aff.exact_kd_molar(F.col("measure"))
    return t.measures(spark, folder).where(molar.isNotNull()).select("pdb", r6(F.log10(molar), "log_kd"))


@query(
    "P4_general_measure",
    with_views(t.MEASURES, SPLIT_MEASURE, body="""SELECT pdb, string_split(measure, delim)[1] AS affinity_type,
      (p_size + 1)::DOUBLE AS value, right(measure, 2) AS unit, delim <> '=' AS vague FROM parts"""),
)
def general_measure(spark, folder):
    parts = t.measures(spark, folder).withColumn("m", aff.measure_parts(F.col("measure")))
    return parts.select("pdb", "m.affinity_type", "m.value", "m.unit", "m.vague")


@query(
    "P5_unit_ladder",
    with_views(t.MEASURES, SPLIT_MEASURE, body="""SELECT pdb, u + 1 AS steps,
      round(log10((p_size + 1) * pow(1000.0::DOUBLE, -(u + 1))), 6) AS log_molar, u = 5 AS bad FROM parts"""),
)
def unit_ladder(spark, folder):
    parts = t.measures(spark, folder).withColumn("m", aff.measure_parts(F.col("measure")))
    steps = aff.ladder_steps(F.col("m.unit"))
    molar = aff.ladder_molar(F.col("m.value"), F.col("m.unit"))
    return parts.select(
        "pdb", steps.cast("long").alias("steps"), r6(F.log10(molar), "log_molar"), (steps == 6).alias("bad")
    )


@query(
    "P6_free_energy",
    with_views(t.MEASURES, SPLIT_MEASURE, body="""SELECT pdb, round(-1.987::DOUBLE * 298.15::DOUBLE *
      ln((p_size + 1) * pow(1000.0::DOUBLE, -(u + 1))) / 1000, 6) AS dG FROM parts"""),
)
def free_energy(spark, folder):
    parts = t.measures(spark, folder).withColumn("m", aff.measure_parts(F.col("measure")))
    molar = aff.ladder_molar(F.col("m.value"), F.col("m.unit"))
    return parts.select("pdb", r6(aff.free_energy(molar), "dG"))


# -- pose filters and terms ---------------------------------------------------


@query(
    "P7_label_words",
    with_views(t.POSES, body="""SELECT type, count(*) AS n FROM poses WHERE list_contains(string_split(type, '_'), 'relax')
      AND list_contains(string_split(type, '_'), 'perturb') GROUP BY type"""),
)
def label_words(spark, folder):
    return aggregate.keep_refined_perturbed(t.poses(spark, folder)).groupBy("type").agg(n_rows("n"))


@query(
    "P8_non_positive",
    with_views(t.POSES, body="""SELECT pdb, count(*) AS n, round(sum(idelta_score), 6) AS idelta FROM poses
      WHERE total_score <= 0 AND idelta_score <= 0 GROUP BY pdb"""),
)
def non_positive(spark, folder):
    kept = aggregate.keep_non_positive(t.poses(spark, folder))
    return kept.groupBy("pdb").agg(n_rows("n"), r6(F.sum("idelta_score"), "idelta"))


def _column_totals(df, columns):
    return long_form(df, columns).groupBy("column_name").agg(
        n_rows("n"), r6(F.sum("value"), "total")
    )


def _column_totals_sql(columns):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count("{c}") AS n, round(sum("{c}"), 6) AS total FROM poses"""
        for c in columns
    )


@query(
    "P9_informative_terms",
    with_views(t.POSES, body=_column_totals_sql([f"raw_delta_{x}" for x in t.INFORMATIVE])),
)
def informative_terms(spark, folder):
    poses = t.poses(spark, folder)
    return _column_totals(poses, terms.varying_columns(poses, terms.raw_delta_columns(poses.columns)))


@query(
    "P10_column_mask",
    with_views(t.POSES, body=_column_totals_sql(
        ["raw_delta_fa_atr", "raw_delta_fa_rep", "raw_delta_fa_elec"])),
)
def column_mask(spark, folder):
    poses = t.poses(spark, folder)
    chosen = terms.matching_columns(poses.columns, "raw_delta_fa", ("sol",), ("raw_delta_fa_pair",))
    return _column_totals(poses, chosen)


VDW_SQL = "raw_delta_fa_atr + raw_delta_fa_rep"
HB_SQL = "raw_delta_hbond_bb_sc + coalesce(raw_delta_hbond_sc, 0)"


@query(
    "P11_term_selection",
    with_views(t.POSES, body=f"""SELECT pdb, row_idx, round(raw_delta_fa_elec, 6) AS raw_delta_fa_elec,
      round({HB_SQL}, 6) AS raw_delta_hbond_combined, round({VDW_SQL}, 6) AS raw_delta_fa_vdw FROM poses"""),
)
def term_selection(spark, folder):
    poses = t.poses(spark, folder)
    rows, chosen = terms.apply_term_selection(
        poses, terms.raw_delta_columns(poses.columns), experiment.COMBINED_VDW
    )
    return rows.select("pdb", "row_idx", *[r6(c, c) for c in chosen])


WEIGHTED_VDW = f"""(0.42::DOUBLE * raw_delta_fa_elec + 1.3::DOUBLE * ({HB_SQL})
  + 0.6::DOUBLE * ({VDW_SQL}))"""


@query(
    "P12_original_weights",
    with_views(t.POSES, body="""SELECT 'raw_delta_fa_elec' AS term, 0.42::DOUBLE AS weight, count(raw_delta_fa_elec) AS n FROM poses
      UNION ALL SELECT 'raw_delta_hbond_combined', 1.3, count(*) FROM poses
      UNION ALL SELECT 'raw_delta_fa_vdw', 0.6, count(*) FROM poses"""),
)
def original_weights(spark, folder):
    poses = t.poses(spark, folder)
    rows, chosen = terms.apply_term_selection(
        poses, terms.raw_delta_columns(poses.columns), experiment.COMBINED_VDW
    )
    weights = terms.resolve_original_weights(chosen, SCORE_WEIGHTS, experiment.COMBINED_VDW)
    counts = long_form(rows, chosen).groupBy(F.col("column_name").alias("term")).agg(n_rows("n"))
    (first, value), *rest = weights.items()
    weight = F.when(F.col("term") == first, F.lit(value))
    for name, value in rest:
        weight = weight.when(F.col("term") == name, F.lit(value))
    return counts.select("term", r6(weight, "weight"), "n")


@query(
    "P13_weighted_score",
    with_views(t.POSES, body=f"SELECT pdb, row_idx, round({WEIGHTED_VDW}, 6) AS score FROM poses"),
)
def weighted_score(spark, folder):
    poses = t.poses(spark, folder)
    rows, chosen = terms.apply_term_selection(
        poses, terms.raw_delta_columns(poses.columns), experiment.COMBINED_VDW
    )
    weights = terms.resolve_original_weights(chosen, SCORE_WEIGHTS, experiment.COMBINED_VDW)
    return rows.select("pdb", "row_idx", r6(terms.weighted_sum(weights), "score"))


@query(
    "P14_raw_energies",
    with_views(t.POSES, body="""SELECT pdb, row_idx, round(raw_delta_fa_atr / 0.8::DOUBLE, 6) AS fa_atr,
      round(raw_delta_fa_rep / 0.4::DOUBLE, 6) AS fa_rep, round(raw_delta_hbond_sc / 1.3::DOUBLE, 6) AS hbond_sc FROM poses"""),
)
def raw_energies(spark, folder):
    return t.poses(spark, folder).select(
        "pdb",
        "row_idx",
        *[
            r6(terms.unweighted(terms.quoted(f"raw_delta_{x}"), SCORE_WEIGHTS[x]), x)
            for x in ("fa_atr", "fa_rep", "hbond_sc")
        ],
    )


@query(
    "P15_start_label",
    with_views(t.POSES, body="""SELECT CASE WHEN type LIKE 'apo_relax%' THEN 'apo_relax' WHEN type LIKE 'relax%' THEN 'relax'
      ELSE 'crystal' END AS start, type, count(*) AS n FROM poses GROUP BY ALL"""),
)
def start_label(spark, folder):
    poses = t.poses(spark, folder).select(text.start_label(F.col("type")).alias("start"), "type")
    return poses.groupBy("start", "type").agg(n_rows("n"))


# -- index and ligands --------------------------------------------------------

REASONED = """flagged AS (
  SELECT *, list_transform(flags, lambda f: lower(trim(f))) AS low FROM annotations),
tagged AS (
  SELECT *, list_filter(list_transform(low, lambda f: CASE WHEN contains(f, 'peptide (xmer)') THEN 'peptide (xmer)'
    WHEN contains(f, 'covalent') THEN 'covalent' WHEN contains(f, 'incomplete ligand') THEN 'incomplete ligand'
    WHEN contains(f, 'redundant') THEN 'redundant' WHEN contains(f, 'resolution') THEN 'resolution'
    WHEN contains(f, 'nmr') THEN 'NMR' END), lambda x: x IS NOT NULL) AS tags FROM flagged),
reasoned AS (
  SELECT *, CASE WHEN len(tags) > 0 THEN tags[1] WHEN TRY_CAST(resolution AS DOUBLE) IS NULL THEN 'NMR'
    WHEN TRY_CAST(resolution AS DOUBLE) > 2.5 THEN 'resolution' ELSE 'kept' END AS reason FROM tagged)"""


def annotated(spark, folder):
    return annotations.with_removal_reason(parse_annotations(t.index_lines(spark, folder)))


@query("P16_flag_filter", with_views(t.ANNOTATIONS, REASONED, body="SELECT pdb, reason FROM reasoned"))
def flag_filter(spark, folder):
    return annotated(spark, folder).select("pdb", "reason")


LIGAND_ATOM_ROWS = """ligand_rows AS (
  SELECT printf('%04d', l_partkey) AS pdb, ['C','N','O','H','H'][l_quantity::BIGINT % 5 + 1] AS e5,
    CASE WHEN l_extendedprice < 1500 THEN 'Fe' ELSE ['C','N','O','H','H'][l_quantity::BIGINT % 5 + 1] END AS element
  FROM lineitem),
profile AS (
  SELECT r.pdb, count(*) FILTER (WHERE element <> 'H') AS heavy_atoms, bool_or(element = 'Fe') AS has_rare,
    CASE WHEN any_value(p.p_partkey) % 9 = 0 THEN NULL ELSE any_value(p.p_size)::DOUBLE / 100 END AS qed
  FROM ligand_rows r LEFT JOIN part p ON r.pdb = printf('%04d', p.p_partkey) GROUP BY r.pdb),
ligand_reasons AS (
  SELECT *, CASE WHEN qed IS NULL THEN 'parse' WHEN qed <= 0.1::DOUBLE THEN 'qed'
    WHEN heavy_atoms < 8 OR heavy_atoms > 500 THEN 'heavy atom count' WHEN has_rare THEN 'rare element'
    ELSE 'kept' END AS reason FROM profile)"""


def ligand_profile_rows(spark, folder):
    common = F.expr("element_at(array('C','N','O','H','H'), cast(cast(l_quantity as long) % 5 + 1 as int))")
    atoms = t.read(spark, folder, "lineitem").select(
        t.pdb_id(F.col("l_partkey")).alias("pdb"),
        F.when(F.col("l_extendedprice") < 1500, "Fe").otherwise(common).alias("element"),
    )
    qed = t.read(spark, folder, "part").select(
        t.pdb_id(F.col("p_partkey")).alias("pdb"),
        F.when(F.col("p_partkey") % 9 == 0, F.lit(None).cast("double"))
        .otherwise(F.col("p_size").cast("double") / 100)
        .alias("qed"),
    )
    return annotations.ligand_reason(annotations.ligand_profile(atoms).join(qed, "pdb", "left"))


@query(
    "P17_ligand_elements",
    with_views(LIGAND_ATOM_ROWS, body="SELECT pdb, heavy_atoms, has_rare, reason FROM ligand_reasons"),
)
def ligand_elements(spark, folder):
    return ligand_profile_rows(spark, folder).select("pdb", "heavy_atoms", "has_rare", "reason")


@query(
    "P18_drug_likeness",
    """SELECT count(*) FILTER (WHERE p_size::DOUBLE / 100 <= 0.1::DOUBLE) AS removed_curation,
      count(*) FILTER (WHERE p_size::DOUBLE / 100 >= 0.2::DOUBLE) AS kept_features FROM part""",
)
def drug_likeness(spark, folder):
    qed = F.col("p_size").cast("double") / 100
    return t.read(spark, folder, "part").agg(
        F.count_if(qed <= 0.1).alias("removed_curation"), F.count_if(holds(qed >= 0.2)).alias("kept_features")
    )


@query(
    "P19_rare_elements",
    with_views(t.ATOMS, body="""SELECT pdb, bool_or(record = 'ATOM' AND trim(element) NOT IN ('C', 'O', 'H')
      OR record = 'HETATM' AND residue = 'UNK' AND trim(element) = 'S') AS has_rare_element FROM atoms GROUP BY pdb"""),
)
def rare_elements(spark, folder):
    atoms = t.structure_atoms(spark, folder)
    receptor = [e for e in COMMON_RECEPTOR_ELEMENTS if e not in ("N", "S")]
    ligand = [e for e in COMMON_LIGAND_ELEMENTS if e != "S"]
    return annotations.rare_element_flag(atoms, receptor, ligand)


# -- feature filters ------------------------------------------------------------


@query(
    "P20_feature_filters",
    with_views(t.FEATURES, body=f"SELECT pdb FROM features WHERE {' AND '.join(t.KEEPS.values())}"),
)
def all_filters(spark, folder):
    return filters.apply_filters(t.features(spark, folder), filters.feature_filters()).select("pdb")


IMPACT = " UNION ALL ".join(
    f"SELECT '{n}' AS filter, count(*) FILTER (WHERE NOT {p}) AS removed FROM features" for n, p in t.KEEPS.items()
)


@query("P21_filter_impact", with_views(t.FEATURES, body=IMPACT))
def filter_impact(spark, folder):
    return filters.filter_impact(t.features(spark, folder), filters.feature_filters()).select("filter", "removed")


WATERFALL = f"""impact AS (SELECT *, row_number() OVER (ORDER BY removed, position) AS step FROM (
  {' UNION ALL '.join(
    f"SELECT '{n}' AS filter, {i} AS position, count(*) FILTER (WHERE NOT {p}) AS removed FROM features"
    for i, (n, p) in enumerate(t.KEEPS.items()))})),
failing AS (SELECT f.pdb, min(i.step) AS first_fail FROM features f, impact i WHERE NOT CASE i.filter
  {' '.join(f"WHEN '{n}' THEN {p}" for n, p in t.KEEPS.items())} END GROUP BY f.pdb),
fates AS (SELECT f.pdb, coalesce(x.first_fail, 99) AS fail FROM features f LEFT JOIN failing x USING (pdb))"""


@query(
    "P22_filter_waterfall",
    with_views(t.FEATURES, WATERFALL, body="""SELECT i.step, i.filter, count(*) FILTER (WHERE fail > i.step) AS remaining,
      count(*) FILTER (WHERE fail = i.step) AS removed FROM impact i, fates GROUP BY ALL"""),
)
def filter_waterfall(spark, folder):
    return filters.waterfall_by_impact(t.features(spark, folder), filters.feature_filters())


@query(
    "P23_exclusion_waterfall",
    with_views(t.ATOMS, t.LIGAND, t.HITS, t.BLOCKS, t.CONTACTS, body="SELECT reason, count(*) AS n FROM verdict GROUP BY reason"),
)
def exclusion_waterfall(spark, folder):
    parts = contact_parts(spark, folder)
    return filters.reason_counts(contacts.curation_verdict(parts.sizes, parts.contacts, 560))


@query(
    "P24_score_differences",
    with_views(t.FEATURES, body="""SELECT pdb, round(abs(crystal_total_score - relax_total_score), 6) AS total_score_difference,
      round(abs(crystal_idelta_score - relax_idelta_score), 6) AS idelta_score_difference FROM features"""),
)
def score_differences(spark, folder):
    return t.features(spark, folder).select(
        "pdb",
        r6(F.abs(F.col("crystal_total_score") - F.col("relax_total_score")), "total_score_difference"),
        r6(F.abs(F.col("crystal_idelta_score") - F.col("relax_idelta_score")), "idelta_score_difference"),
    )


@query(
    "P25_selections",
    with_views(t.FEATURES, body="""SELECT count(*) FILTER (WHERE qed IS NOT NULL) AS with_qed,
      count(*) FILTER (WHERE rmsd_relax_to_crystal < 2) AS close, count(*) FILTER (WHERE crystal_idelta_score > 0) AS positive,
      count(*) FILTER (WHERE crystal_idelta_score <= 0) AS negative FROM features"""),
)
def selections(spark, folder):
    return t.features(spark, folder).agg(
        F.count_if(F.col("qed").isNotNull()).alias("with_qed"),
        F.count_if(F.col("rmsd_relax_to_crystal") < 2).alias("close"),
        F.count_if(F.col("crystal_idelta_score") > 0).alias("positive"),
        F.count_if(F.col("crystal_idelta_score") <= 0).alias("negative"),
    )


# -- logs ----------------------------------------------------------------------


def _like(phrases):
    return " OR ".join(f"contains(line, '{p}')" for p in phrases)


CLASSES = f"""classes AS (SELECT job, {', '.join(
    f"bool_or({_like(p)}) AS {n}" for n, p in t.LOG_WORDS.items())} FROM log_lines GROUP BY job)"""
ENGINE_SQL = "(unrecognized_residue OR variant OR disulfide OR missing_atom)"


@query(
    "P26_log_classes",
    with_views(t.LOG_LINES, CLASSES, body=f"SELECT *, {ENGINE_SQL} AS engine_error FROM classes"),
)
def log_classes(spark, folder):
    return logs.classify_jobs(t.log_lines(spark, folder), t.LOG_WORDS)


@query(
    "P27_first_token",
    with_views(t.LOG_LINES, body=r"""SELECT j.job, m.token FROM (SELECT DISTINCT job FROM log_lines) j LEFT JOIN (
      SELECT job, list_last(string_split(regexp_replace(trim(line), '\s+', ' ', 'g'), ' ')) AS token FROM log_lines
      WHERE contains(line, 'tion') QUALIFY row_number() OVER (PARTITION BY job ORDER BY line_no) = 1) m USING (job)"""),
)
def first_token(spark, folder):
    return logs.first_match(t.log_lines(spark, folder), "tion")


@query(
    "P28_job_family",
    with_views(t.LOG_LINES, body="""SELECT string_split(job, '_')[1] AS family, job, count(*) AS n FROM log_lines
      WHERE contains(line, 'tion') GROUP BY ALL"""),
)
def job_family(spark, folder):
    rows = t.log_lines(spark, folder).where(F.col("line").contains("tion"))
    return rows.groupBy(text.job_family(F.col("job")).alias("family"), "job").agg(n_rows("n"))


@query(
    "P29_human_size",
    """SELECT o_orderkey, CASE WHEN o_orderkey = 0 THEN '0 B' WHEN b < 1024 THEN printf('%.2f B', b)
      WHEN b < 1048576 THEN printf('%.2f KB', b / 1024) WHEN b < 1073741824 THEN printf('%.2f MB', b / 1048576)
      WHEN b < 1099511627776 THEN printf('%.2f GB', b / 1073741824) ELSE printf('%.2f TB', b / 1099511627776) END AS size_text
      FROM (SELECT o_orderkey, (o_orderkey * (o_orderkey % 3 * 100000 + 1) * (1 + o_orderkey % 2 * 5000))::DOUBLE AS b FROM orders)""",
)
def human_size(spark, folder):
    k = F.col("o_orderkey")
    size = (k * (k % 3 * 100000 + 1) * (1 + k % 2 * 5000)).cast("double")
    return t.read(spark, folder, "orders").select("o_orderkey", text.human_size(size).alias("size_text"))


# -- structure text ---------------------------------------------------------------


def word_pairs(spark, folder):
    """Conversation turns as base and changed line arrays of equal length."""
    base = F.split("text", " ")
    new = F.transform(base, lambda w, i: F.when(F.length(w) == 3, F.reverse(w)).otherwise(w))
    return t.read(spark, folder, "conversations").select(
        "conv_id", "turn", base.alias("base"), new.alias("new")
    )


PAIRS = """words AS (SELECT conv_id, turn, string_split(text, ' ') AS base FROM conversations),
changed AS (SELECT conv_id, turn, base, list_transform(base,
  lambda w: CASE WHEN length(w) = 3 THEN reverse(w) ELSE w END) AS new FROM words)"""


@query(
    "P30_text_delta",
    with_views(PAIRS, body="""SELECT conv_id, turn, n_changed, round(1 - n_changed / total, 6) AS saved_share, changes FROM (
      SELECT conv_id, turn, len(base) AS total, len(d) AS n_changed, array_to_string(d, '|') AS changes FROM (
        SELECT conv_id, turn, base, list_filter(list_transform(range(1, len(base) + 1),
          lambda i: CASE WHEN base[i] <> new[i] THEN (i - 1)::VARCHAR || ':' || new[i] END), lambda x: x IS NOT NULL) AS d
        FROM changed))"""),
)
def text_delta(spark, folder):
    rows = word_pairs(spark, folder).withColumn("d", delta.changed_lines(F.col("base"), F.col("new")))
    entries = F.array_sort(F.map_entries("d"))
    listed = F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["key"], e["value"])), "|")
    return rows.select(
        "conv_id",
        "turn",
        F.size("d").cast("long").alias("n_changed"),
        r6(delta.saved_share(F.col("base"), F.col("d")), "saved_share"),
        listed.alias("changes"),
    )


@query("P31_text_patch", with_views(PAIRS, body="SELECT conv_id, turn, md5(array_to_string(new, ' ')) AS digest FROM changed"))
def text_patch(spark, folder):
    rows = word_pairs(spark, folder).withColumn("d", delta.changed_lines(F.col("base"), F.col("new")))
    patched = delta.patched_lines(F.col("base"), F.col("d"))
    return rows.select("conv_id", "turn", F.md5(F.array_join(patched, " ")).alias("digest"))


@query(
    "P32_cleaned_lines",
    with_views(t.ATOMS, t.LIGAND, t.HITS, t.BLOCKS, t.CONTACTS, body="""SELECT pdb, line_no FROM all_lines l WHERE record = 'TER'
      OR (record = 'ATOM' AND element <> ' H' AND EXISTS (SELECT 1 FROM contacts c
        WHERE c.pdb = l.pdb AND c.role = 'chain' AND c.name = l.chain))
      OR (record = 'HETATM' AND EXISTS (SELECT 1 FROM contacts c WHERE c.pdb = l.pdb AND c.role = 'cofactor'
        AND c.name = l.atom_name AND c.atom_no = l.atom_no))"""),
)
def cleaned_lines(spark, folder):
    parts = contact_parts(spark, folder)
    return contacts.cleaned_lines(t.structure_lines(spark, folder), parts.contacts).select("pdb", "line_no")


@query(
    "P34_term_labels",
    with_views(t.POSES, body=" UNION ALL ".join(
        f"SELECT '{x}' AS term, count(raw_delta_{x}) AS n FROM poses" for x in t.INFORMATIVE)),
)
def term_labels(spark, folder):
    poses = t.poses(spark, folder)
    rows = long_form(poses, terms.raw_delta_columns(poses.columns))
    return rows.groupBy(text.clean_term(F.col("column_name")).alias("term")).agg(n_rows("n"))


@query(
    "P35_lead_scores",
    with_views(t.POSES, body="""SELECT pdb, row_idx, round(total_score, 6) AS total_score, round(idelta_score, 6) AS idelta_score,
      round(rmsd_to_crystal, 6) AS rmsd_to_crystal, round(rmsd_to_input, 6) AS rmsd_to_input, prepare_time
      FROM poses WHERE type = 'relax_docking_perturb'"""),
)
def lead_scores(spark, folder):
    rows = store.lead_scores(t.poses(spark, folder), "relax_docking_perturb")
    rounded = ("total_score", "idelta_score", "rmsd_to_crystal", "rmsd_to_input")
    return rows.select("pdb", "row_idx", *[r6(c, c) for c in rounded], "prepare_time")
