"""Names, units, weights, allow-lists and targets.

These must equal the published inputs and outputs for results to agree, so they
are stated once, as plain text, and imported everywhere else.
"""

# Score-function weights per energy term.
SCORE_WEIGHTS = {
    "???": 4.914646529436531e252,
    "fa_atr": 0.8,
    "fa_rep": 0.4,
    "fa_sol": 0.6,
    "fa_intra_rep": 0.004,
    "fa_elec": 0.42,
    "pro_close": 1.0,
    "fa_pair": 0.8,
    "hbond_sr_bb": 2.0,
    "hbond_lr_bb": 2.0,
    "hbond_bb_sc": 1.3,
    "hbond_sc": 1.3,
    "dslf_ss_dst": 0.5,
    "dslf_cs_ang": 2.0,
    "dslf_ss_dih": 5.0,
    "dslf_ca_dih": 5.0,
    "atom_pair_constraint": 1.0,
    "coordinate_constraint": 0.5,
    "angle_constraint": 1.0,
    "dihedral_constraint": 1.0,
    "rama": 0.2,
    "omega": 0.5,
    "fa_dun": 0.4,
    "p_aa_pp": 0.5,
    "ref": 1.0,
    "chainbreak": 1.0,
}

# Leading score columns of every pose row.
LEAD_COLUMNS = (
    "total_score",
    "idelta_score",
    "rmsd_to_crystal",
    "rmsd_to_input",
    "prepare_time",
)

# Interface terms that never vary and carry no information.
ZERO_VARIANCE_TERMS = (
    "raw_delta_fa_intra_rep",
    "raw_delta_pro_close",
    "raw_delta_hbond_sr_bb",
    "raw_delta_hbond_lr_bb",
    "raw_delta_dslf_ss_dst",
    "raw_delta_dslf_cs_ang",
    "raw_delta_dslf_ss_dih",
    "raw_delta_dslf_ca_dih",
    "raw_delta_atom_pair_constraint",
    "raw_delta_coordinate_constraint",
    "raw_delta_angle_constraint",
    "raw_delta_dihedral_constraint",
    "raw_delta_rama",
    "raw_delta_omega",
    "raw_delta_fa_dun",
    "raw_delta_p_aa_pp",
    "raw_delta_ref",
    "raw_delta_chainbreak",
)

# Unit to molar factors of the affinity index.
UNIT_TO_MOLAR = {"mM": 1e-3, "uM": 1e-6, "nM": 1e-9, "pM": 1e-12, "fM": 1e-15, "M": 1.0}

# An exact Kd measurement in the affinity index.
EXACT_KD_PATTERN = r"^Kd=([0-9]+(?:\.[0-9]+)?)(mM|uM|nM|pM|fM|M)\b"

# Delimiters of a general measurement, in order of trial.
MEASURE_DELIMITERS = (">=", "<=", "=", "~", ">", "<")

# Unit ladder of a general measurement, one factor 1000 per step.
UNIT_LADDER = ("mM", "uM", "nM", "pM", "fM", "BAD")

# Gas constant (cal/mol/K) and temperature (K).
GAS_CONSTANT = 1.987
TEMPERATURE = 298.15

# Annotation flags that remove an entry, in order of trial.
REMOVE_FLAGS = (
    "peptide (xmer)",
    "covalent",
    "incomplete ligand",
    "redundant",
    "resolution",
    "NMR",
)

# Phrases that make an annotation flag a known one.
ALLOWED_FLAGS = (
    "ligand is",
    "kd",
    "ic50",
    "ki",
    "+/-",
    "ph",
    "isomer",
    "contain",
    "temp",
    "kon",
    "koff",
    "supplementary information",
    "crystal",
    "complex",
    "mm",
    "fragment",
    "affinity",
    "assay",
    "binding",
    "bortezomib",
    "carfilzomib",
    "compound ",
    "mutation: yes",
    "residues ",
    "different ligand structure",
)

# Elements allowed in a curated ligand.
LIGAND_ELEMENTS = ("C", "S", "O", "N", "Cl", "P", "F", "Br", "I", "H")

# Residues kept as cofactors near the ligand; water is dropped later.
KEPT_COFACTORS = (
    " ZN", " MG", " MN", " CA", " NA", "  K", " FE", " NI", " CO", "FE2", "HOH",
)
DROPPED_COFACTORS = ("HOH",)

# Common elements by role in the feature table.
COMMON_RECEPTOR_ELEMENTS = (
    "C", "S", "O", "N", "ZN", "CA", "CO", "MG", "NI", "MN", "FE", "NA", "K", "SE", "P", "CD", "H",
)
COMMON_LIGAND_ELEMENTS = ("C", "S", "O", "N", "CL", "P", "F", "BR", "I", "B", "H")

# Curation thresholds.
CONTACT_RADIUS = 7.0
MAX_RESOLUTION = 2.5
MAX_PROTEIN_SIZE = 1000
HEAVY_ATOM_RANGE = (8, 500)
MIN_CURATION_QED = 0.1

# Run stages with their target row counts, in run order.
STAGE_TARGETS = {
    "crystal": 1,
    "relax": 10,
    "apo_relax": 10,
    "crystal_docking_perturb": 300,
    "crystal_docking_std": 300,
    "relax_docking_perturb": 300,
    "relax_docking_std": 300,
    "apo_relax_docking_perturb": 300,
    "apo_relax_docking_std": 300,
}
START_LABELS = ("crystal", "relax", "apo_relax")
LAST_DOCKING_LABEL = "apo_relax_docking_std"

# Log rules, class -> phrases.
LOG_RULES = {
    "index_error": ("IndexError",),
    "oserror": ("OSError",),
    "unrecognized_residue": ("Unrecognized residue",),
    "variant": ("with variant",),
    "disulfide": ("disulfide",),
    "missing_atom": ("missing_atom",),
    "oom": ("Out Of Memory", "Bus error"),
    "keyerror": ("KeyError",),
}
# Rules that together form the scoring-engine class.
ENGINE_RULES = ("unrecognized_residue", "variant", "disulfide", "missing_atom")
SELECTED_PHRASE = "selected complex"
PROCESS_PHRASE = "Process "

# The 25 energy terms of the feature table.
FEATURE_TERMS = (
    "angle_constraint", "atom_pair_constraint", "chainbreak", "coordinate_constraint",
    "dihedral_constraint", "dslf_ca_dih", "dslf_cs_ang", "dslf_ss_dih", "dslf_ss_dst",
    "fa_atr", "fa_dun", "fa_elec", "fa_intra_rep", "fa_pair", "fa_rep", "fa_sol",
    "hbond_bb_sc", "hbond_lr_bb", "hbond_sc", "hbond_sr_bb", "omega", "p_aa_pp",
    "pro_close", "rama", "ref",
)

# Interface-energy histogram window and bins.
HEATMAP_BINS = 70
HEATMAP_X = (-30.0, 5.0)
HEATMAP_Y = (-23.0, 2.0)

# Share of a train set kept for training when it has no val set.
CARVED_TRAIN_SHARE = 0.9
