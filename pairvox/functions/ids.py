"""Ids, file names and labels: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Id grammars by year, regions, long names.
CASE_2025, CASE_2023 = r"(?:(AB|HN|TH)_)?(1(AB|HN|TH)?([A-D])\d{3})", r"(?:(B|P)_)?(1(B|P)?([A-C])\d{3})"
TOKEN_LOOSE, TOKEN_STRICT = r"1(?:AB|HN|TH|B|P)?[A-D]?[0-9]{3}", r"1(?:AB|HN|TH|B|P)[A-D][0-9]{3}"
REGION_NAMES = {"AB": "Abdomen", "HN": "Head-Neck", "TH": "Thorax", "B": "Brain", "P": "Pelvis"}


def _match(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def parse_case_id(c: Column) -> Column:
    """Struct (token, body, center, year); the 2025 grammar first, then the 2023 one; null if neither fits. The body is the prefix, else the code in the token, else UNK."""
    parts = lambda p, year: F.struct(
        _match(c, p, 2).alias("token"), F.coalesce(_match(c, p, 1), _match(c, p, 3), F.lit("UNK")).alias("body"), _match(c, p, 4).alias("center"), F.lit(year).alias("year")
    )
    return F.when(c.rlike(CASE_2025), parts(CASE_2025, 2025)).when(c.rlike(CASE_2023), parts(CASE_2023, 2023))


def extract_token(c: Column, *, strict: bool = False) -> Column:
    return _match(c, TOKEN_STRICT if strict else TOKEN_LOOSE, 0)


def slice_patient(c: Column) -> Column:
    """Patient of `<patient>-<n>`, else of `<patient>_<n>`."""
    return F.coalesce(_match(c, r"^(.+)-(\d+)(?:\.nii(?:\.gz)?)?$", 1), _match(c, r"^(.+)_(\d+)(?:\.nii(?:\.gz)?)?$", 1))


def slice_number(c: Column) -> Column:
    return F.coalesce(_match(c, r"^(.+)-(\d+)(?:\.nii(?:\.gz)?)?$", 2), _match(c, r"^(.+)_(\d+)(?:\.nii(?:\.gz)?)?$", 2)).cast("long")


def stem(c: Column) -> Column:
    return F.regexp_replace(c, r"\.nii(\.gz)?$", "")


def volume_id(c: Column) -> Column:
    """What stands before the last dash of a name without its extension."""
    return _match(stem(c), "^(.*)-([^-]*)$", 1)


def slice_id(c: Column) -> Column:
    return _match(stem(c), "^(.*)-([^-]*)$", 2)


def region_prefix(c: Column) -> Column:
    return F.when(F.instr(c, "_") > 0, F.substring_index(c, "_", 1)).otherwise("UNK")


def hospital(c: Column) -> Column:
    """The third letter of what follows the region prefix, else UNK."""
    letters = F.regexp_replace(F.regexp_replace(c, "^[^_]*_", ""), "[^A-Za-z]", "")
    return F.coalesce(F.nullif(F.substring(letters, 3, 1), F.lit("")), F.lit("UNK"))


def center_by_pattern(c: Column) -> Column:
    """0, 1 or 2 for centres A to C of abdomen slice names, else null."""
    return F.ascii(_match(c, r"AB_\dAB*([ABC])\d+-\d+\.nii", 1)).cast("long") - 65


def center_by_position(c: Column, place: int) -> Column:
    return F.substring(c, place, 1)


def region_center_year(c: Column) -> Column:
    """Struct (region, center, year, center_year) from the letters of the middle segment: the last one is the centre."""
    letters = F.regexp_replace(F.split_part(stem(c), F.lit("_"), F.lit(2)), "[^A-Za-z]", "")
    region = F.left(letters, F.greatest(F.length(letters) - 1, F.lit(0)))
    center = F.right(letters, F.lit(1))
    year = F.when(region.isin("B", "P"), "2023").otherwise("2025")
    return F.struct(region.alias("region"), center.alias("center"), year.alias("year"), F.concat_ws("_", center, year).alias("center_year"))


def hospital_code(c: Column, region: Column, year: Column) -> Column:
    """The character after the last region code in the id, with the year before it; empty if there is none."""
    at = F.length(c) - F.instr(F.reverse(c), F.reverse(region)) + 2
    code = F.substr(c, at, F.lit(1))
    return F.when((F.instr(c, region) == 0) | (code == ""), "").otherwise(F.concat(year.cast("string"), code))


def normalize_roi_name(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def sanitize_token(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, "[^A-Za-z0-9_-]", "_"), F.lit("_"))


def add_suffix(c: Column, suffix: str = "_cp256") -> Column:
    return F.regexp_replace(c, r"^(.*?)(\.nii(?:\.gz)?)?$", f"$1{suffix}$2")


def drop_suffix(c: Column, suffix: str = "_cp256") -> Column:
    return F.regexp_replace(c, rf"{suffix}(\.nii(?:\.gz)?)?$", "$1")


def region_label(c: Column) -> Column:
    """Long name of a region prefix; null for an unknown one."""
    return F.create_map(*(F.lit(x) for kv in REGION_NAMES.items() for x in kv))[c]


def roi_role(name: Column, targets: list[str], oars: list[str]) -> Column:
    """PTV for targets and names with PTV but for rings, OAR for organs at risk, else null."""
    return F.when(name.isin(*targets) | (name.contains("PTV") & (name != "Ring PTV")), "PTV").when(name.isin(*oars), "OAR")


def dvh_label(name: Column, indicator: Column) -> Column:
    return F.concat_ws("_", name, F.replace(indicator, F.lit("_"), F.lit("")))


def short_model_label(c: Column) -> Column:
    return F.coalesce(_match(c, "abdomen_(.*)$", 1), c)


def family(models: Column, name: str) -> Column:
    """An aggregate: the family's name if all models contain it, else null."""
    return F.when(F.bool_and(F.contains(models, F.lit(name))), F.lit(name))


def model_lookup(model_type: Column, region: Column, models: dict[str, dict[str, str]], *, strict: bool = False) -> Column:
    """The model of a type and region; null for unknown ones, or an error if strict."""
    pairs = {f"{t}\x1f{r}": m for t, own in models.items() for r, m in own.items()}
    found = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))[F.concat_ws("\x1f", model_type, region)]
    return F.coalesce(found, F.raise_error(F.concat_ws(" ", F.lit("no model for"), model_type, region))) if strict else found


def recode(c: Column, mapping: dict[int, int]) -> Column:
    """Labels by a map, each once; others unchanged."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))[c], c)


def derive_paths(c: Column, *, modality: str = "MR", suffix: str = "_cp256") -> Column:
    """Struct (folder, file, path, mask_path) from an example path: the last part names the folder, and files in it by rule."""
    folder = basename(c)
    file = F.concat(folder, F.lit(f"_{modality}{suffix}.nii.gz"))
    mask = F.concat(folder, F.lit("/new_masks/"), folder, F.lit("_mask_from_CT_treshold.nii.gz"))
    return F.struct(folder.alias("folder"), file.alias("file"), F.concat_ws("/", folder, F.lit(modality), file).alias("path"), mask.alias("mask_path"))


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def parse_id_list(c: Column) -> Column:
    """Distinct ids in order from a list with commas or white space."""
    return F.array_sort(F.array_distinct(F.filter(F.split(c, r"[,\s]+"), lambda x: x != "")))
