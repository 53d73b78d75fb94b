"""Joins of cases, modalities, manifests and regions of interest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampType

from pairvox.functions.ids import TOKEN_LOOSE, extract_token


def required_kinds(files: DataFrame, *, case: str, kind: str, required: list[str]) -> DataFrame:
    """Cases that have all required kinds."""
    found = files.filter(F.col(kind).isin(*required)).groupBy(case).agg(F.countDistinct(kind).alias("_n"))
    return found.filter(F.col("_n") == len(required)).select(case)


def missing_kinds(files: DataFrame, *, case: str, kind: str, required: list[str]) -> DataFrame:
    """(case, missing): the required kinds that a case lacks, joined by commas, for cases that lack any."""
    have = files.groupBy(case).agg(F.collect_set(kind).alias("_have"))
    lacks = F.array_except(F.array(*map(F.lit, sorted(required))), F.col("_have"))
    return have.select(case, F.array_join(F.array_sort(lacks), ",").alias("missing")).filter("missing <> ''")


def prefer_first(df: DataFrame, *, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def case_catalog(files: DataFrame, *, case: str, kind: str, path: str, rank: Column, required: list[str], optional: list[str] = ()) -> DataFrame:
    """One row a case with the chosen path of each kind; cases without a required one go."""
    kinds = [*required, *optional]
    chosen = [F.min_by(path, F.when(F.col(kind) == k, F.struct(rank, F.col(path)))).alias(k) for k in kinds]
    return files.groupBy(case).agg(*chosen).na.drop(subset=list(required))


def pair_equal(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b, on)


def unpaired(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b.select(*on).distinct(), on, "left_anti")


def members(df: DataFrame, manifest: DataFrame, on: str) -> DataFrame:
    """Rows whose key the manifest has, with its columns; a repeated manifest key counts once."""
    return df.join(manifest.dropDuplicates([on]), on)


def fallback(df: DataFrame, sources: list[DataFrame], on: str, value: str) -> DataFrame:
    """The value of the first source that has the key."""
    out = df
    for i, s in enumerate(sources):
        out = out.join(s.select(on, F.col(value).alias(f"_v{i}")), on, "left")
    names = [f"_v{i}" for i in range(len(sources))]
    return out.withColumn(value, F.coalesce(*names)).drop(*names)


def roi_pairs(real: DataFrame, fake: DataFrame, on: list[str], metrics: list[str], *, floor: float | None = None, floor_on: list[str] = ()) -> DataFrame:
    """Rows of both sides with metrics renamed _real and _fake; only those whose fake values reach the floor."""
    side = lambda df, s: df.select(*on, *(F.col(m).alias(f"{m}_{s}") for m in metrics))
    out = side(real, "real").join(side(fake, "fake"), on)
    return out.filter(reduce(lambda x, y: x & y, [F.col(f"{m}_fake") >= floor for m in floor_on])) if floor is not None else out


def complete_pairs(df: DataFrame, subject: list[str], condition: str, n: int = 2) -> DataFrame:
    """Rows of subjects seen under n conditions."""
    full = df.groupBy(*subject).agg(F.countDistinct(condition).alias("_n")).filter(F.col("_n") == n).select(*subject)
    return df.join(full, subject, "left_semi")


def modulo_pairs(a: DataFrame, b: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """Item i of a with item i mod size(b), both in key order. Numbers come from ranges of the keys, not from one sort in one task."""
    n = b.count()
    left = numbered(a, a_key).select(F.col(a_key), F.pmod("number", F.lit(max(n, 1))).alias("_m"))
    return _by_number(left, b, b_key)


def random_pairs(a: DataFrame, b: DataFrame, a_key: str, b_key: str, *, seed: int = 42) -> DataFrame:
    """Each item of a with an item of b that md5(seed:key) picks, the same each time."""
    n = b.count()
    pick = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(a_key).cast("string"))), 1, 8), 16, 10).cast("long") % max(n, 1)
    return _by_number(a.select(F.col(a_key), pick.alias("_m")), b, b_key)


def _by_number(left: DataFrame, b: DataFrame, b_key: str) -> DataFrame:
    return left.join(numbered(b, b_key).select(F.col(b_key), F.col("number").alias("_m")), "_m").drop("_m")


#: Ranges of a global order at most; their bounds are one short array.
RANGES = 4096


def range_of(df: DataFrame, key: str, *, per: int) -> Column:
    """The number of a range of the key that a row lies in, in key order; -1 for a null key. Equal keys are in one range.

    Bounds are sketched quantiles of the key (so sparse or uneven keys make even ranges of about `per` rows), RANGES at
    most; they are a literal, and the range is found in two steps of 64. With more than RANGES * per rows ranges grow with
    the table, and so do those of a value that many rows have; give distinct values with their counts where ties are many.
    Keys without a sketch (text) are bounded by those whose hashes fall into one of many classes, about 64 a range; they
    place the bounds only, and each row has its range by comparison.
    """
    rows = df.count()
    n = min(RANGES, rows // per + 1)
    if n == 1:
        cuts = []
    elif isinstance(df.schema[key].dataType, (NumericType, DateType, TimestampType)):
        cuts = df.agg(F.percentile_approx(key, [k / n for k in range(1, n)], 10 * RANGES)).first()[0]
    else:
        some = df.filter(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(max(1, rows // (64 * n)))) == 0)).groupBy(F.col(key).alias("_key")).count().sort("_key").collect()
        total, upto, cuts = sum(r["count"] for r in some), 0, []
        for r in some:
            if upto * n // total < (upto + r["count"]) * n // total:
                cuts.append(r["_key"])
            upto += r["count"]
    cuts = sorted(set(cuts or []))
    bucket = F.lit(0)
    if cuts:
        groups = [cuts[k : k + 64] for k in range(0, len(cuts), 64)]
        at_most = lambda bounds: F.size(F.filter(bounds, lambda c: c <= F.col(key)))
        first = F.greatest(at_most(F.array(*(F.lit(g[0]) for g in groups))) - 1, F.lit(0))
        bucket = 64 * first + at_most(F.get(F.array(*(F.array(*map(F.lit, g)) for g in groups)), first))
    return F.when(F.col(key).isNull(), -1).otherwise(bucket).cast("int")


def numbered(df: DataFrame, key: str, *, per: int = 100_000) -> DataFrame:
    """df with `number`, the place of each row in key order from 0; equal keys get places in any order, a null key comes first. Rows are counted by range and numbered inside theirs."""
    rows = df.withColumn("_bucket", range_of(df, key, per=per))
    counts = rows.groupBy("_bucket").count()
    before = counts.select("_bucket", (F.sum("count").over(Window.orderBy("_bucket")) - F.col("count")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy(key)) - 1
    return rows.withColumn("_own", own).join(before, "_bucket").withColumn("number", F.col("_before") + F.col("_own")).drop("_bucket", "_own", "_before")


def case_numbers(files: DataFrame, *, file: str, prefix: str, masks: DataFrame | None = None, mask: str | None = None) -> DataFrame:
    """files with case_name, {prefix}_001 and on by sorted name, and with the mask at the same place of the sorted masks (their column `mask`).

    Files beyond the last mask get null, masks beyond the last file go. Equal names get numbers of their own, in any order;
    names without value come first.
    """
    named = numbered(files, file).withColumn("case_name", F.format_string(f"{prefix}_%03d", F.col("number") + 1))
    if masks is not None:
        places = numbered(masks.select(mask), mask)
        named = named.join(places, "number", "left")
    return named.drop("number")


def uniform_bin(v: Column, lo: float, hi: float, n: int) -> Column:
    """The bin from 0 to n - 1 of n equal ones; hi belongs to the last; null outside."""
    k = F.floor((v - lo) / ((hi - lo) / n)).cast("long")
    return F.when((v >= lo) & (v <= hi), F.least(k, F.lit(n - 1).cast("long")))


def segment_join(df: DataFrame, segments: list[tuple[float, float, str]], v: str, name: str = "segment") -> DataFrame:
    """Rows with the segment that their value lies in; rows in none go. segments: (lo, hi, label) in order without overlap, a parameter; nothing is joined."""
    k = F.size(F.filter(F.array(*(F.lit(float(lo)) for lo, _, _ in segments)), lambda lo: lo <= F.col(v)))
    hi, label = (F.array(*(F.lit(s[i]) for s in segments)) for i in (1, 2))
    return df.filter((k > 0) & (F.col(v) < F.get(hi, k - 1))).withColumn(name, F.get(label, k - 1))


def aligned(image: DataFrame, mask: DataFrame, synthetic: DataFrame | None = None) -> DataFrame:
    """Slices of the image with the arrays `mask` and `synthetic` of the same place, one join a slice and none a pixel.

    A mask that is absent or of another shape is null, so metrics fall back to all pixels. A synthetic slice that is
    absent or of another shape drops the row.
    """
    side = lambda df, n: df.select("volume_id", "z", F.col("height").alias("_h"), F.col("width").alias("_w"), F.col("px").alias(n))
    fits = (F.col("_h") == F.col("height")) & (F.col("_w") == F.col("width"))
    out = image.join(side(mask, "_mask"), ["volume_id", "z"], "left").withColumn("mask", F.when(fits, F.col("_mask"))).drop("_h", "_w", "_mask")
    if synthetic is not None:
        out = out.join(side(synthetic, "synthetic"), ["volume_id", "z"]).filter(fits).drop("_h", "_w")
    return out


def token_matches(cases: DataFrame, files: DataFrame, *, case: str, name: str, kind: str = "MR") -> tuple[DataFrame, DataFrame]:
    """((case, token, name), (case, token) without a file): the first file, in name order, that begins with the case's token and names the kind after it.

    The token is cut out of the case id, or is the id itself; a file's is what it begins with: a token, or what stands
    before the last `_kind`. So the join is on equal keys.
    """
    own = cases.select(case, F.coalesce(extract_token(F.col(case)), F.col(case)).alias("token"))
    begins = F.coalesce(F.nullif(F.regexp_extract(name, f"^({TOKEN_LOOSE}).*{kind}.*nii", 1), F.lit("")), F.nullif(F.regexp_extract(name, f"^(.*?)_?{kind}[^/]*nii", 1), F.lit("")))
    best = files.select(begins.alias("token"), name).filter("token IS NOT NULL").groupBy("token").agg(F.min(name).alias(name))
    return own.join(best, "token").select(case, "token", name), own.join(best, "token", "left_anti").select(case, "token")


def mask_or_and(masks: list[DataFrame], body: DataFrame | None, *, least: int = 1000) -> DataFrame:
    """(volume_id, z, y, x) in any of the masks and in the body (where one is given), of volumes with `least` such voxels or more."""
    key = ["volume_id", "z", "y", "x"]
    either = reduce(DataFrame.union, [m.select(*key) for m in masks]).distinct()
    own = either.join(body.select(*key).distinct(), key, "left_semi") if body is not None else either
    enough = own.groupBy("volume_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select("volume_id")
    return own.join(enough, "volume_id", "left_semi")


def patient_match(df: DataFrame, wanted: DataFrame, *, case: str, id_: str) -> DataFrame:
    """Rows whose id, or what follows its first underscore, is wanted."""
    after = F.when(F.instr(case, "_") > 0, F.expr(f"substring(`{case}`, instr(`{case}`, '_') + 1)"))
    keys = df.withColumn("_row", F.struct(*df.columns)).select("_row", F.explode(F.array_distinct(F.filter(F.array(F.col(case), after), lambda x: x.isNotNull()))).alias("_id"))
    return keys.join(wanted.select(F.col(id_).alias("_id")).distinct(), "_id", "left_semi").select("_row").distinct().select("_row.*")


def missing_pairs(requested: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """Requested rows whose keys are not present."""
    return requested.join(present.select(*on).distinct(), on, "left_anti")


def grid_check(meta: DataFrame, *, case: str, kind: str, pair: tuple[str, str], fields: dict[str, float]) -> DataFrame:
    """(case, status): OK, MISS (a side is absent) or MISM with the first field that differs. fields: their tolerances, 0 for exact; a field may be an array."""
    side = lambda k: meta.filter(F.col(kind) == k).select(case, F.lit(True).alias(f"_{k}"), *(F.col(f).alias(f"{f}_{k}") for f in fields))
    both = side(pair[0]).join(side(pair[1]), case, "full")
    bad = [F.when(~_close(F.col(f"{f}_{pair[0]}"), F.col(f"{f}_{pair[1]}"), 0.0, tolerance, "array" in meta.schema[f].dataType.simpleString()), f"MISM:{f}") for f, tolerance in fields.items()]
    return both.select(case, F.when(F.col(f"_{pair[0]}").isNull() | F.col(f"_{pair[1]}").isNull(), "MISS").otherwise(F.coalesce(*bad, F.lit("OK"))).alias("status"))


def _close(a: Column, b: Column, relative: float, absolute: float, arrays: bool = True) -> Column:
    """Whether numbers, or all numbers of two arrays, differ by at most a share of the larger one or by the absolute tolerance; false for nulls."""
    if arrays:
        return F.coalesce((F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: _close(x, y, relative, absolute, False)), lambda x: x), F.lit(False))
    return F.coalesce(F.abs(a - b) <= F.greatest(relative * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute)), F.lit(False))


def reference_check(images: DataFrame, reference: DataFrame, *, case: str) -> DataFrame:
    """(case, status) of images (size, spacing, origin, direction) against a reference grid (shape, spacing, 4 x 4 affine).

    Shapes are equal, spacings differ by a thousandth at most, origin and direction by a hundredth, where the affine may
    be read as it stands or with its first two axes turned round. Otherwise MISS (no reference) or MISM with the reason.
    """
    ref = reference.select(case, F.col("shape").alias("_shape"), F.col("spacing").alias("_spacing"), F.col("affine").alias("_affine"))
    joined = images.join(ref, case, "left")
    cell = lambda r, c: F.get(F.get("_affine", F.lit(r)), F.lit(c)).cast("double")
    norm = [F.sqrt(sum((cell(r, c) * cell(r, c) for r in range(3)), F.lit(0.0))) for c in range(3)]
    sign = lambda turn, r: -1.0 if turn and r < 2 else 1.0
    fits = [
        _close(F.col("origin"), F.array(*(sign(turn, r) * cell(r, 3) for r in range(3))), 1e-2, 1e-2)
        & _close(F.col("direction"), F.array(*(sign(turn, r) * cell(r, c) / F.nullif(norm[c], F.lit(0.0)) for c in range(3) for r in range(3))), 1e-2, 1e-2)
        for turn in (False, True)
    ]
    status = (
        F.when(F.col("_shape").isNull(), "MISS").when(F.col("size") != F.col("_shape"), "MISM:shape")
        .when(~_close(F.col("spacing"), F.col("_spacing"), 1e-3, 1e-3), "MISM:spacing").when(~(fits[0] | fits[1]), "MISM:orientation").otherwise("OK")
    )
    return joined.select(case, status.alias("status"))


def require_ok(checks: DataFrame) -> DataFrame:
    """The same rows; a status other than OK is an error once it is read."""
    return checks.withColumn("status", F.when(F.col("status") == "OK", F.col("status")).otherwise(F.raise_error(F.concat(F.lit("grids differ: "), F.col("status")))))


def pending(cases: DataFrame, outputs: DataFrame, *, case: str, kind: str, required: list[str]) -> DataFrame:
    """Cases without all required outputs."""
    return cases.join(required_kinds(outputs, case=case, kind=kind, required=required), case, "left_anti")


def select_runs(runs: DataFrame, *, name: str, include: str, exclude: list[str], done: DataFrame) -> DataFrame:
    """Runs that aren't excluded, match the pattern and aren't done."""
    return runs.filter(~F.col(name).isin(*exclude) & F.col(name).rlike(include)).join(done, name, "left_anti")


def missing_items(cases: DataFrame, present: DataFrame, *, case: str, item: str, required: list[str]) -> DataFrame:
    """(case, item) that are required and absent; the required list is a literal array, so nothing is crossed."""
    want = cases.select(case, F.explode(F.array(*map(F.lit, required))).alias(item))
    return want.join(present.select(case, item).distinct(), [case, item], "left_anti")


def run_coverage(wanted: DataFrame, outputs: DataFrame, *, run: str, case: str) -> DataFrame:
    """(run, found, missing) over the wanted (run, case) rows."""
    have = outputs.select(run, case, F.lit(1).alias("_have")).distinct()
    joined = wanted.join(have, [run, case], "left")
    return joined.groupBy(run).agg(F.count("_have").alias("found"), F.count_if(F.col("_have").isNull()).alias("missing"))
