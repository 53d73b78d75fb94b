"""Metric tables, result files, logs and layouts."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from pairvox.operators.quantiles import few
from pairvox.operators.spread import cut

#: Metric names and the line format of training logs.
METRICS = ["MAE", "MSE", "PSNR", "SSIM"]
LOG_LINE = r"\(epoch: (\d+), iters: (\d+), time: ([\d.]+), data: ([\d.]+)\)"
LOG_SCHEMA = {"epoch": "long", "iters": "long", "time": "double", "data": "double"}

#: Ids up to this size are sent to every worker.
SHIPPED_BYTES = 16 << 20


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Slice metrics from CSV: bare legacy names count for both kinds, text in numbers becomes null, a missing mask size 0."""
    raw = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path)
    if "file_name" not in raw.columns:
        raise ValueError("file_name is missing")
    have = set(raw.columns)
    out = [F.col("file_name")]
    for m in METRICS:
        for kind in ("unmasked", "masked"):
            source = f"{m}_{kind}" if f"{m}_{kind}" in have else m
            if source not in have:
                raise ValueError(f"{m}_{kind} is missing")
            value = F.expr(f"try_cast(`{source}` AS double)")
            out.append(F.when(~F.isnan(value), value).alias(f"{m}_{kind}"))
    mask = F.expr("try_cast(mask_voxels AS bigint)") if "mask_voxels" in have else F.lit(0).cast("long")
    return raw.select(*out, mask.alias("mask_voxels"))


def finite_only(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN and infinities in the columns become null."""
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c in columns})


def non_finite_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*(F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))).alias(c) for c in columns))


def union_experiments(rows: DataFrame, runs: DataFrame, *, key: str, region: Column, needed: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with run columns, without rows that hold a null; checks (run, lost_pct, regions, ok)): a run may lose 5 percent, and has to show `needed` regions."""
    joined = rows.join(runs, key)
    kept = joined.na.drop()
    sizes = joined.groupBy(key).agg(F.count("*").alias("_all"))
    seen = kept.withColumn("_region", region).groupBy(key).agg(F.count("*").alias("_kept"), F.count_distinct("_region").alias("regions"), F.max(needed).alias("_needed"))
    checks = sizes.join(seen, key, "left").select(key, (100 - 100 * F.coalesce("_kept", F.lit(0)) / F.col("_all")).alias("lost_pct"), F.coalesce("regions", F.lit(0)).alias("regions"), F.coalesce((F.col("_kept") >= 0.95 * F.col("_all")) & (F.col("regions") == F.col("_needed")), F.lit(False)).alias("ok"))
    return kept, checks


def read_runs(spark: SparkSession, paths: list[str], schema: str, *, run: str = r"([^/]+)/[^/]+$", renamed: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows (run, file, columns of schema), bad lines (run, file, line, why)) of CSV files of many runs, in one scan.

    Each file has a header of its own: columns come by name, in any order; those that a file lacks are null, those that
    schema doesn't name are left out, and `renamed` gives new names for old ones. Spaces around names and a byte order mark don't matter.
    The run is the first group of the pattern in the file's path. A line with more fields than its header, or with text
    that isn't of a column's type, is kept apart with the reason, and not among the rows. Empty text is null. A line is a
    row: quoted line feeds within fields are not for these files.
    """
    out = parse_runs(spark, paths, schema, run=run, renamed=renamed)
    names = [c for c in out.columns if c not in ("run", "file", "line", "why")]
    return out.filter("why IS NULL").select("run", "file", *(F.col(f"`{c}`") for c in names)), out.filter("why IS NOT NULL").select("run", "file", "line", "why")


def parse_runs(spark: SparkSession, paths: list[str], schema: str, *, run: str = r"([^/]+)/[^/]+$", renamed: dict[str, str] | None = None) -> DataFrame:
    """(run, file, line, why, columns of schema): every line of read_runs' files, with the reason where it is bad, else null.

    What depends on a file alone (its run, where its columns stand) is worked out once a file. A line is split once: a row of
    an array is computed before filters see it, whereas a filter on a column repeats what the column is made of.
    """
    fields = spark.createDataFrame([], schema).schema
    lines = spark.read.text(paths, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).filter("trim(value) <> ''")
    first = cut(lines.filter("block = 0").groupBy("file").agg(F.min_by("value", "n").alias("header"), F.min("n").alias("at")))
    widest = first.agg(F.max(F.size(F.split("header", ",")))).first()[0] or 1
    parts = ", ".join(f"c{i} string" for i in range(widest + 1))
    parsed = lambda c: F.from_csv(c, F.lit(parts), {"mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    row = lambda s: F.array(*(F.col(f"{s}.c{i}") for i in range(widest + 1)))
    once = lambda c: F.explode(F.array(c))
    old = F.create_map(*(F.lit(x) for kv in (renamed or {}).items() for x in kv)) if renamed else None
    plain = lambda x: F.trim(F.regexp_replace(x, "^\ufeff", ""))
    names = F.transform(F.filter(row("_h"), lambda x: x.isNotNull()), lambda x: F.coalesce(old[plain(x)], plain(x)) if renamed else plain(x))
    heads = first.withColumn("_h", parsed("header")).select("file", "at", names.alias("_names"))
    places = [F.array_position("_names", f.name).cast("int").alias(f"_p{i}") for i, f in enumerate(fields)]
    heads = few(cut(heads.select("file", "at", F.regexp_extract("file", run, 1).alias("run"), F.size("_names").alias("_width"), *places)))
    body = lines.join(heads, "file").filter("n <> at").withColumn("_c", once(parsed("value"))).withColumn("_v", row("_c"))
    given = [F.when(F.col(f"_p{i}") > 0, F.nullif(F.get("_v", F.col(f"_p{i}") - 1), F.lit(""))).alias(f"_s{i}") for i in range(len(fields))]
    extra = F.exists(F.slice("_v", F.col("_width") + 1, widest + 1), lambda x: x.isNotNull()).alias("_extra")
    body = body.select("run", "file", "value", once(F.struct(extra, *given)).alias("_r")).select("run", "file", "value", "_r.*")
    typed = body.select("*", *(F.expr(f"try_cast(_s{i} AS {f.dataType.simpleString()})").alias(f"_t{i}") for i, f in enumerate(fields)))
    wrong = [F.when(F.col(f"_s{i}").isNotNull() & F.col(f"_t{i}").isNull(), F.lit(f.name)) for i, f in enumerate(fields)]
    why = F.when(F.col("_extra"), F.lit("more fields than names")).otherwise(F.nullif(F.concat_ws(", ", *wrong), F.lit("")))
    return typed.select("run", "file", F.col("value").alias("line"), why.alias("why"), *(F.col(f"_t{i}").alias(f.name) for i, f in enumerate(fields)))


def flatten_results(df: DataFrame) -> DataFrame:
    """(index, metric, value) from results: array<map<string, double>>."""
    return df.select(F.posexplode("results").alias("index", "_r")).select("index", F.explode("_r").alias("metric", "value"))


def flatten_aggregates(df: DataFrame) -> DataFrame:
    """(metric, stat, value) from aggregates: map<string, map<string, double>>."""
    return df.select(F.explode("aggregates").alias("metric", "_s")).select("metric", F.explode("_s").alias("stat", "value"))


def read_results_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    raw = spark.read.schema("results array<map<string, double>>, aggregates map<string, map<string, double>>").option("multiLine", True).json(path)
    return flatten_results(raw), flatten_aggregates(raw)


def parse_loss_lines(lines: DataFrame, losses: list[str], line: str = "value") -> DataFrame:
    """Epoch, iterations, times and losses of training-log lines; other lines go."""
    fields = [F.regexp_extract(line, LOG_LINE, i + 1).cast(kind).alias(name) for i, (name, kind) in enumerate(LOG_SCHEMA.items())]
    loss = [F.expr(f"try_cast(regexp_extract(`{line}`, '{n}: (-?[0-9.eE+-]+)', 1) AS double)").alias(n) for n in losses]
    return lines.filter(F.col(line).rlike(LOG_LINE)).select(*fields, *loss)


def read_loss_log(spark: SparkSession, path: str, losses: list[str]) -> DataFrame:
    return parse_loss_lines(spark.read.text(path), losses)


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """df as Parquet in folders by the columns `by`. Only folders that df has rows for are replaced; others stay as they are, and none is there half written.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_split_layout(slices: DataFrame, path: str) -> None:
    """By split and domain; those without rows here stay."""
    write_partitions(slices, path, ["split", "domain"])


def write_region_layout(slices: DataFrame, path: str, *, name: str) -> None:
    """By body region, the part of the name before its first _; names without one are left out. Regions, splits and domains without rows here stay."""
    write_partitions(slices.filter(F.instr(name, "_") > 0).withColumn("region", F.substring_index(name, "_", 1)), path, ["region", "split", "domain"])


def write_volume_metrics(df: DataFrame, path: str) -> None:
    """By experiment; experiments without rows here stay."""
    write_partitions(df, path, ["experiment"])


def copy_subset(files: DataFrame, ids: DataFrame, *, name: str, id_: str, extensions: list[str], few: int = 2000, shipped: int = SHIPPED_BYTES) -> DataFrame:
    """Files with a known extension whose name holds a listed id.

    Up to `few` ids are looked for in each name in place. More, up to `shipped` bytes of them as measured, become an
    automaton in every worker that finds any of them in one pass over a name. Beyond that names are joined with ids on
    equal pieces, of the ids' lengths, of which few that are no ids are shuffled. The result is the same; an empty id is in every name.
    """
    fine = F.lit(False)
    for e in extensions:
        fine = fine | F.endswith(F.col(name), F.lit(e))
    files, ids = files.filter(fine), ids.select(F.col(id_).alias("_id")).filter("_id IS NOT NULL").distinct()
    listed = [r[0] for r in ids.limit(few + 1).collect()]
    if len(listed) <= few:
        held = F.exists(F.array(*map(F.lit, listed)), lambda x: F.contains(F.col(name), x)) if listed else F.lit(False)
        return files.filter(held).dropDuplicates()
    if ids.agg(F.sum(F.octet_length("_id") + 8)).first()[0] <= shipped:
        return files.mapInArrow(_finder(files.sparkSession, [r[0] for r in ids.collect()], files.columns.index(name)), files.schema).dropDuplicates()
    lengths = [r[0] for r in ids.select(F.octet_length("_id")).distinct().collect()]  # as many as there are lengths of ids
    if 0 in lengths:
        return files.dropDuplicates()
    ids = ids.select(F.col("_id").cast("binary"))
    return _likely_pieces(files, ids, name, lengths).join(ids, "_id", "left_semi").drop("_id").dropDuplicates()


#: Bits of the filter that pieces of names pass before they are shuffled, and bits set by an id. Its size is fixed: more ids let more pieces pass, the join decides.
FILTER_BITS, FILTER_HASHES = 1 << 27, 4


def _likely_pieces(files: DataFrame, ids: DataFrame, name: str, lengths: list[int]) -> DataFrame:
    """files with `_id` (bytes): a row for each piece of a name that has the length of an id and passes a filter of the ids' hashes; all pieces that are ids do."""
    at, base, bits, hashes = files.columns.index(name), np.uint64(0x9E3779B97F4A7C15), FILTER_BITS, FILTER_HASHES

    def sums(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of bytes times powers of an odd base, and the inverse powers: differences give each piece's hash."""
        body = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
        power = lambda x: np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(body), x, np.uint64)]))
        return np.concatenate([[np.uint64(0)], np.cumsum(body * power(base)[:-1], dtype=np.uint64)]), power(np.uint64(pow(int(base), -1, 1 << 64)))

    def places(h: np.ndarray, k: int) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return (h + np.uint64(k) * ((h >> np.uint64(32)) | np.uint64(1))) & np.uint64(bits - 1)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            total, inverse = sums(texts)
            ends = np.cumsum([len(x) for x in texts])
            starts = ends - [len(x) for x in texts]
            h = (total[ends] - total[starts]) * inverse[starts]
            bit = np.concatenate([places(h, k) for k in range(hashes)])
            yield pa.RecordBatch.from_arrays([pa.array((bit >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (bit & np.uint64(63))).view(np.int64))], ["word", "bits"])

    words = ids.mapInArrow(build, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = files.sparkSession.sparkContext.broadcast(table.view(np.uint64))
    schema = StructType([*files.schema.fields, StructField("_id", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            texts = [x.encode() for x in batch.column(at).to_pylist()]
            sizes = np.array([len(x) for x in texts], np.int64)
            total, inverse = sums(texts)
            owner, ends = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes)
            for n in lengths:
                own = np.flatnonzero(np.arange(len(owner)) + n <= ends[owner])
                h = (total[own + n] - total[own]) * inverse[own]
                for k in range(hashes):
                    bit = places(h, k)
                    fine = (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                    own, h = own[fine], h[fine]
                rows = owner[own]
                begins = own - (ends - sizes)[rows]
                pieces = pa.array([texts[r][b : b + n] for r, b in zip(rows.tolist(), begins.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, pieces], schema.names)

    return files.mapInArrow(run, schema)


_AUTOMATA: dict[int, object] = {}


def _finder(spark: SparkSession, ids: list[str], at: int):
    """A function for mapInArrow that keeps rows whose column `at` holds any of the ids; the automaton is built once a worker."""
    listed = spark.sparkContext.broadcast(ids)
    number = listed._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in _AUTOMATA:
            import ahocorasick

            automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for x in filter(None, listed.value):
                automaton.add_word(x)
            automaton.make_automaton()
            _AUTOMATA.clear()
            _AUTOMATA[number] = automaton
        found, every = _AUTOMATA[number].iter, "" in listed.value
        for batch in batches:
            names = batch.column(at).to_pylist()
            yield batch.filter(pa.array([x is not None and (every or next(found(x), None) is not None) for x in names], pa.bool_()))

    return run


def restructure(files: DataFrame, *, case: str, kind: str, folders: dict[str, str]) -> DataFrame:
    """files with `target`, folder/case.ext of known kinds; others go."""
    folder = F.create_map(*(F.lit(x) for kv in folders.items() for x in kv))[F.col(kind)]
    return files.withColumn("target", F.concat_ws("/", folder, F.col(case))).filter(folder.isNotNull())


def results_manifest(cases: DataFrame, outputs: DataFrame, *, case: str) -> tuple[DataFrame, DataFrame]:
    """(records (case, output, input, errors), cases without output)."""
    done = cases.join(outputs, case).withColumn("errors", F.array().cast("array<string>"))
    return done, cases.join(outputs, case, "left_anti")


def _affine(raw: bytes, order: str, spacing: tuple) -> list[list[float]]:
    """The 4 x 4 voxel-to-world matrix of a NIfTI header: its rows if given, else the quaternion, else spacings alone."""
    by_quaternion, by_rows = struct.unpack(f"{order}2h", raw[252:256])
    if by_rows > 0:
        return [list(struct.unpack(f"{order}4f", raw[280 + 16 * k : 296 + 16 * k])) for k in range(3)] + [[0.0, 0.0, 0.0, 1.0]]
    if by_quaternion > 0:
        b, c, d, x, y, z = struct.unpack(f"{order}6f", raw[256:280])
        a = max(0.0, 1.0 - b * b - c * c - d * d) ** 0.5
        turn = [
            [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
            [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
            [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
        ]
        sides = (spacing[0], spacing[1], spacing[2] * (-1.0 if struct.unpack(f"{order}f", raw[76:80])[0] < 0 else 1.0))
        return [[*(t * s for t, s in zip(row, sides, strict=True)), o] for row, o in zip(turn, (x, y, z), strict=True)] + [[0.0, 0.0, 0.0, 1.0]]
    return [[spacing[0], 0.0, 0.0, 0.0], [0.0, spacing[1], 0.0, 0.0], [0.0, 0.0, spacing[2], 0.0], [0.0, 0.0, 0.0, 1.0]]


def read_nifti(spark: SparkSession, path: str) -> DataFrame:
    """(volume_id, z, height, width, px, sx, sy, sz, affine) from .nii and .nii.gz files, one row a slice, rows in y; files of both byte orders.

    A file is read by one task, whole: what a task holds is one volume. The affine is as the file has it (RAS); its last
    column is the origin, its others, by their lengths, the directions.
    """
    kinds = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, body in zip(pdf["path"], pdf["content"], strict=True):
                raw = gzip.decompress(body) if name.endswith(".gz") else bytes(body)
                order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
                nx, ny, nz = (max(1, d) for d in struct.unpack(f"{order}8h", raw[40:56])[1:4])
                kind = struct.unpack(f"{order}h", raw[70:72])[0]
                spacing = struct.unpack(f"{order}8f", raw[76:108])[1:4]
                start, slope, shift = int(struct.unpack(f"{order}f", raw[108:112])[0]), *struct.unpack(f"{order}2f", raw[112:120])
                cube = np.frombuffer(raw, f"{order}{kinds[kind]}", nx * ny * nz, start).reshape(nz, ny, nx).astype(np.float64)
                cube = cube * slope + shift if slope not in (0.0, 1.0) or shift else cube
                stem = name.rsplit("/", 1)[-1].removesuffix(".gz").removesuffix(".nii")
                yield pd.DataFrame({"volume_id": stem, "z": np.arange(nz), "height": ny, "width": nx, "px": list(cube.reshape(nz, -1)), "sx": spacing[0], "sy": spacing[1], "sz": spacing[2], "affine": [_affine(raw, order, spacing)] * nz})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.nii*").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, "volume_id string, z long, height int, width int, px array<double>, sx double, sy double, sz double, affine array<array<double>>")
