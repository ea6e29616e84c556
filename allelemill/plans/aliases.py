"""Known names of the columns of summary statistics and the shapes of columns that hold several values."""

from __future__ import annotations

#: Input names of each standard column. Fixed values.
ALIASES = {
    "variant_id": ["variant_id"],
    "chr": ["chr", "SNPChr", "CHROM", "chromosome", "Chromosome", "CHR", "ISmet_chr", "Chr", "Chromsome", "chrom", "WMHmet_chr", "CHROMOSOME", "BImet_chr", "#CHROM"],
    "pos": ["pos", "SNPPos", "position", "GENPOS", "Position", "POS", "ISmet_position", "BP", "Pos", "Pos_b37", "MapInfo", "Physical_Location", "PhysPos", "chromStart", "WMHmet_position", "POSITION", "BImet_pos"],
    "ref": ["ref", "OtherAllele", "other_allele.outcome", "other_allele.exposure", "nea", "ALLELE0", "NEA", "Noncoded_allele", "Non_coded_allele", "noncoded_all", "Other_allele", "WMHmet_NonEffAllele", "BImet_ref.noncoded", "REF"],
    "alt": ["alt", "AssessedAllele", "effect_allele.outcome", "effect_allele.exposure", "ea", "ALLELE1", "SNPEffectAllele", "Effect_allele", "Effect allele (EA)", "EA", "effallele", "Coded_allele", "coded_all", "ALT"],
    "effect": ["effect", "slope", "beta", "BETA", "MetaBeta", "b", "Estimate_Effect", "genoxt2d.b", "Effect", "Est", "Estimate_effect", "Beta"],
    "pval": ["pval", "pval_nominal", "Pvalue", "p", "MetaP", "P_value", "P value", "genoxt2d.p", "PVAL", "P", "P.value", "ISmet_pvalue", "WMHmet_P", "BImet_meta.p", "P-value"],
    "log10p": ["LOG10P", "LOG10_P"],
    "effect_se": ["effect_se", "slope_se", "se", "SE", "MetaSE", "b_se", "StdErr"],
    "zscore": ["Zscore", "Test statistic", "WMHmet_ZScore"],
    "odds_ratio": ["OR"],
    "allele1": ["Allele_1", "Allele 1", "Allele1", "a1", "A1", "allele1", "ISmet_allele1"],
    "allele2": ["Allele_2", "Allele 2", "Allele2", "a2", "A2", "allele2", "ISmet_allele2"],
    "rsid": ["rsid", "id", "MarkerName", "ID"],
}

#: (input name, shape of its values, names of the parts, where to split). Fixed values.
ENCODED = [
    ("MarkerName", r"^[^:]{1,2}:[0-9]+$", ["chr", "pos"], ":"),
    ("MarkerName", r"^b3[6-8]-c[^:]{1,2}:[0-9]+-[0-9]+$", ["build", "chr", "pos"], "-c|:|-"),
    ("MarkerName", r"^[^:]+:[0-9]+:[^:]+$", ["chr", "pos"], ":"),
    ("MarkerName", r"^[^:]{1,2}:[0-9]+:[a-zA-Z]+:[a-zA-Z]+$", ["chr", "pos"], ":"),
    ("chr_colon_pos", r"^[^:]{1,2}:[0-9]+$", ["chr", "pos"], ":"),
    ("Chr_Pos", r"^[^:]{1,2}:[0-9]+(:ID)?$", ["chr", "pos"], ":"),
    ("SNPAlleles", r"^[ACGTNacgtn]+/[ACGTNacgtn]+$", ["ref", "alt"], "/"),
]
RSID = r"^rs[0-9]+$"  #: values that a column must have to count as rsid
TEXT_COLUMNS = ["EXTRA"]  #: columns that are text whatever their values look like

#: Keys of the FORMAT column of a single-trait VCF with the columns they stand for. Fixed values.
TRAIT_FORMAT = {"ES": "effect", "SE": "effect_se", "LP": "log10p", "AF": "af", "SS": "sample_size", "EZ": "zscore", "SI": "imputation_accuracy", "NC": "n_cases", "ID": "rsid"}
VCF_COLUMNS = ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"]


def standard_names(extra: dict[str, list[str]] | None = None, only: dict[str, list[str]] | None = None) -> dict[str, str]:
    """input name -> standard name; extra names are added, ``only`` replaces the dictionary."""
    table = {k: list(v) for k, v in (only or ALIASES).items()}
    for k, v in (extra or {}).items():
        table.setdefault(k, []).extend(v)
    return {name: std for std, names in table.items() for name in names}
