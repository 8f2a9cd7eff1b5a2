"""Fixed values the results depend on: lookup tables, constants and formats."""

from __future__ import annotations

# --- Fixed values: prediction targets and their task ------------------------
PHENOTYPE_TARGETS = {
    "optimal_temperature_c": "regression",
    "optimal_ph": "regression",
    "oxygen_requirement": "classification",
    "salt_tolerance_pct": "regression",
}
REGRESSION_TARGETS = ("optimal_temperature_c", "optimal_ph", "salt_tolerance_pct")

# --- Fixed values: growth flags that count as positive ----------------------
POSITIVE_GROWTH = ("positive", "yes", "+", "true")

# --- Fixed values: amino acids ----------------------------------------------
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
AROMATIC = "FWY"
POSITIVE_CHARGE = "KRH"
NEGATIVE_CHARGE = "DE"
IVYWREL = "IVYWREL"
# Kyte-Doolittle hydropathy
HYDROPATHY = {
    "A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2,
    "I": 4.5, "K": -3.9, "L": 3.8, "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5,
    "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3,
}
# Lehninger pKa values
PKA_N_TERMINUS = 9.69
PKA_C_TERMINUS = 2.34
PKA_POSITIVE = {"K": 10.53, "R": 12.48, "H": 6.00}
PKA_NEGATIVE = {"D": 3.65, "E": 4.25, "C": 8.33, "Y": 10.07}
PI_STEPS = 50
PI_PROTEINS = 200
PI_DEFAULT = 7.0

# --- Fixed values: nucleotides ----------------------------------------------
NUCLEOTIDES = "ACGT"

# --- Fixed values: marker profiles (profile id, column name) by category ----
MARKERS = {
    "temperature": [
        ("PF00012", "Hsp70_DnaK"), ("PF00183", "Hsp90"), ("PF00118", "Cpn60_GroEL"),
        ("PF00011", "Hsp20"), ("PF00313", "CSD_cold_shock"), ("PF02824", "TGS_thermosome"),
    ],
    "ph": [
        ("PF00006", "ATP_synth_alphabeta"), ("PF00306", "ATP_synth_alphabeta_C"),
        ("PF00430", "ATP_synth_F0_B"), ("PF00999", "NhaA_Na_H_exch"),
        ("PF06450", "NhaB_Na_H_exch"), ("PF00282", "Pyridoxal_decarbox"),
        ("PF01618", "MotA_TolQ_ExbB"), ("PF03224", "V_ATPase_subH_N"),
    ],
    "oxygen": [
        ("PF00115", "COX1_aerobic"), ("PF02790", "COX2_TM_aerobic"),
        ("PF00116", "COX2_periplasm_aero"), ("PF13442", "Cyt_CBB3_microaero"),
        ("PF00355", "Rieske_2Fe2S"), ("PF00199", "Catalase"), ("PF00081", "SOD_FeMn"),
        ("PF00080", "SOD_CuZn"), ("PF02906", "FeFe_hyd_anaerobic"),
        ("PF00374", "NiFe_hyd_anaerobic"), ("PF00890", "FAD_binding_FrdA"),
        ("PF00037", "Fer4_FeS_4Fe4S"),
    ],
    "salt": [
        ("PF02702", "KdpD_osmosensor"), ("PF02386", "TrkH_K_channel"),
        ("PF02028", "BCCT_compatible"), ("PF00528", "BPD_transp_1"),
        ("PF06339", "EctC_ectoine_synth"), ("PF01036", "Bact_rhodopsin"),
    ],
    "vitamin": [
        ("PF00590", "TP_methylase_B12"), ("PF01497", "Peripla_BP_2"),
        ("PF00763", "THF_DHG_CYH_folate"), ("PF02152", "FolB_folate"),
        ("PF03740", "PdxJ_pyridoxine"), ("PF00926", "DHBP_riboflavin"),
    ],
    "nitrogen": [
        ("PF00142", "NifH_nitrogenase"), ("PF00148", "NifDK_nitrogenase"),
        ("PF03460", "NIR_SIR_ferredoxin"),
    ],
    "carbon": [
        ("PF00016", "RuBisCO_large_form1"), ("PF00101", "RuBisCO_small_form1"),
        ("PF00128", "Alpha_amylase"), ("PF00150", "Cellulase_GH5"),
        ("PF00553", "CBM_cellulose"),
    ],
    "special": [("PF00384", "Molybdopterin_OR"), ("PF13361", "UvrD_helicase_C")],
}
CATEGORIES = ("temperature", "ph", "oxygen", "salt", "vitamin", "nitrogen", "carbon", "special")

# --- Fixed values: hit limits ------------------------------------------------
MAX_EVALUE = 1e-5
MAX_MARKER_PROTEINS = 16
MAX_PROTEIN_LENGTH = 1022

# --- Fixed values: oxygen classes -------------------------------------------
OXYGEN_COLLAPSE = {
    "aerobe": "aerobe",
    "obligate aerobe": "aerobe",
    "anaerobe": "anaerobe",
    "obligate anaerobe": "anaerobe",
    "facultative anaerobe": "facultative",
    "facultative aerobe": "facultative",
    "aerotolerant": "facultative",
    "microaerotolerant": "facultative",
    "microaerophile": "microaerophile",
}
OXYGEN_CLASSES = ("aerobe", "anaerobe", "facultative_anaerobe", "microaerobe")

# --- Fixed values: host keyword -> kingdom, first match wins -----------------
HOST_KINGDOM_KEYWORDS = (
    ("human", "human"), ("homo sapiens", "human"), ("patient", "human"), ("infant", "human"),
    ("mouse", "animal"), ("rat", "animal"), ("cow", "animal"), ("bovine", "animal"),
    ("pig", "animal"), ("swine", "animal"), ("chicken", "animal"), ("fish", "animal"),
    ("honey bee", "animal"), ("insect", "animal"), ("termite", "animal"),
    ("bird", "animal"), ("tick", "animal"),
    ("plant", "plant"), ("rice", "plant"), ("wheat", "plant"), ("soybean", "plant"),
    ("tomato", "plant"), ("leaf", "plant"), ("root", "plant"), ("rhizosphere", "plant"),
    ("fungus", "fungal"), ("yeast", "fungal"), ("mushroom", "fungal"),
)
HOST_KINGDOMS = ("human", "animal", "plant", "fungal", "other")

# --- Fixed values: accession versions tried in order ------------------------
ACCESSION_VERSIONS = (".1", ".2", ".3", ".4")

# --- Fixed values: assembly level preference ---------------------------------
ASSEMBLY_LEVEL_RANK = {"Complete Genome": 0, "Chromosome": 1, "Scaffold": 2, "Contig": 3}
ASSEMBLY_LEVEL_OTHER = 99

# --- Fixed values: sequence file suffixes ------------------------------------
FASTA_SUFFIXES = (".fna", ".fna.gz", ".fa", ".fa.gz", ".fasta", ".fasta.gz")

# --- Fixed values: medium rules ----------------------------------------------
MIN_STRAINS_PER_MEDIUM = 100
NACL_PATTERN = r"sodium chlor|^nacl$"
NACL_CAP_PCT = 30.0

# --- Fixed values: column order of combined predictions ----------------------
PREDICTION_COLUMNS = (
    "bacdive_id",
    "genome_accession",
    "pred_optimal_temperature_c",
    "pred_optimal_temperature_c_low_80",
    "pred_optimal_temperature_c_high_80",
    "pred_optimal_ph",
    "pred_optimal_ph_low_80",
    "pred_optimal_ph_high_80",
    "pred_salt_tolerance_pct",
    "pred_salt_tolerance_pct_low_80",
    "pred_salt_tolerance_pct_high_80",
    "pred_oxygen_requirement",
    "pred_oxygen_requirement_confidence",
    "pred_oxygen_requirement_source",
)


def kmers(length: int) -> list[str]:
    """All words of ``length`` nucleotides in alphabetical order."""
    words = [""]
    for _ in range(length):
        words = [word + base for word in words for base in NUCLEOTIDES]
    return words


def marker_rows() -> list[tuple[str, str, str]]:
    """``(profile, marker, category)`` for every marker."""
    return [
        (profile, name, category)
        for category in CATEGORIES
        for profile, name in MARKERS[category]
    ]
