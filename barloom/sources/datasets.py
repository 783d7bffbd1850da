"""Immutable published datasets: staged publishing, digests per file, verification.

Layout under a root: ``datasets/<run>/year=.../`` holds the files of one run of a publisher,
``manifests/<dataset id>/run=<run>/`` one row per file, written last. No folder is renamed, replaced
or written by two, so publishers that run at once cannot damage each other: each commits its own
manifest to its own files, and readers take the run of least name whose manifest is complete.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import BARS, MANIFEST

PRIMARY_KEY = ("symbol", "trade_date")
# A sha256 is cut into four parts of 15 hex digits, each below 2**60.
PARTS = (1, 16, 31, 46)
PART_DIGITS = 15
MODULUS, LIMB = 2 ** 60, 20
SUMS = ("s0", "s1", "s2", "s3")
STORED = T.StructType([*BARS.fields, T.StructField("year", T.IntegerType())])


class DatasetError(ValueError):
    """Raised when a dataset may not be published or does not verify."""


def _with_parts(df: DataFrame, columns: Sequence[Column | str], *keep: Column | str) -> DataFrame:
    """``keep`` and the parts of each row's hash as whole numbers, computed once a row."""
    hashed = df.select(*keep, F.sha2(F.concat_ws("|", *columns), 256).alias("_hash"))
    kept = hashed.columns[:-1]
    return hashed.select(*kept, *[
        F.conv(F.substring("_hash", start, PART_DIGITS), 16, 10).cast("bigint").alias(f"_{s}")
        for s, start in zip(SUMS, PARTS, strict=True)])


def fingerprint_columns() -> list[Column]:
    """Order-free digest of a multiset of rows: the row count and, per part of the row
    hashes, their sum. Sums combine on the map side, so no rows are gathered or sorted.

    A part of 60 bits is summed in three of 20 bits, which are whole numbers for up to 2**43 rows;
    only what is summed up is a decimal.
    """
    def total(part: str, shift: int) -> Column:
        bits = F.shiftright(f"_{part}", shift).bitwiseAND(F.lit(2 ** LIMB - 1))
        return F.sum(bits).cast("decimal(38,0)") * F.lit(2 ** shift)

    return [F.count("*").alias("row_count"), *[
        ((total(s, 0) + total(s, LIMB) + total(s, 2 * LIMB)) % MODULUS).cast("bigint").alias(s)
        for s in SUMS]]


def dataset_fingerprint(df: DataFrame, columns: Sequence[Column | str],
                        identity: Mapping[str, str]) -> DataFrame:
    """One row: the content identity of a dataset.

    Independent of row order, partitioning and run time; dependent on the identity fields
    and every listed column. Columns must have one text form (integers, dates, strings).
    """
    return _named(_with_parts(df, columns).agg(*fingerprint_columns()), identity)


def _named(digest: DataFrame, identity: Mapping[str, str]) -> DataFrame:
    named = [F.lit(f"{k}={identity[k]}") for k in sorted(identity)]
    text = F.concat_ws("|", *named, "row_count", *SUMS)
    return digest.select("row_count", F.sha2(text, 256).alias("fingerprint"))


def merged(stats: DataFrame, *keys: Column) -> DataFrame:
    """Statistics of files added up to those of their groups, or of the dataset: the parent nodes
    of a digest tree whose root is the fingerprint."""
    return stats.groupBy(*keys).agg(
        F.sum("row_count").alias("row_count"), F.min("min_trade_date").alias("min_trade_date"),
        F.max("max_trade_date").alias("max_trade_date"),
        *[(F.sum(F.col(c).cast("decimal(38,0)")) % MODULUS).cast("bigint").alias(c) for c in SUMS])


def bar_text_columns() -> list[Column]:
    """Bars as text; a double has one shortest text form that reads back to it."""
    return [F.col(c).cast("string") for c in BARS.names]


def file_stats(spark: SparkSession, path: str) -> DataFrame:
    """Size, rows, dates and digest of every stored file, in one pass over all of them."""
    stored = spark.read.schema(STORED).parquet(path)
    name = F.concat_ws("/", F.slice(F.split("_metadata.file_path", "/"), -2, 2))
    rows = _with_parts(stored, bar_text_columns(), name.alias("path"),
                       F.col("_metadata.file_size").alias("file_size"), "trade_date")
    return rows.groupBy("path", "file_size").agg(
        *fingerprint_columns(),
        F.min("trade_date").alias("min_trade_date"), F.max("trade_date").alias("max_trade_date"))


def publish_dataset(bars: DataFrame, root: str, *, as_of: str, source: str, source_version: str,
                    generated_at: str, dataset_family: str = "daily-bars",
                    normalization_version: str = "v1", quality_passed: bool = True,
                    evidence: Mapping[str, DataFrame] | None = None) -> str:
    """Publish bars under their content id and return the id.

    The input is computed once: it is staged in a folder of its own, by year and in order of the
    primary key, and everything else is read from the staged files, whose digests add up to the
    id. The manifest is written last and marks the dataset as complete. A published id is never
    overwritten: publishing the same content again empties its own staging folder and returns the
    id. Evidence goes to a sibling tree that the loader never reads, with an index of its digests.
    """
    spark = bars.sparkSession
    if not quality_passed:
        raise DatasetError("data that failed its quality gate may not be published")
    identity = {"family": dataset_family, "normalization": normalization_version,
                "as_of": as_of, "source": source, "source_version": source_version}
    run = uuid.uuid4().hex
    path = f"{root}/datasets/{run}"
    keyed = bars.select(*BARS.names, F.year("trade_date").alias("year"))
    (keyed.repartitionByRange("year", *PRIMARY_KEY).sortWithinPartitions("year", *PRIMARY_KEY)
     .write.mode("errorifexists").partitionBy("year").parquet(path))

    staged = f"{root}/staging/{run}"
    file_stats(spark, path).write.mode("errorifexists").parquet(staged)
    stats = spark.read.parquet(staged)
    total, head = merged(stats).first(), _named(merged(stats), identity).first()
    dataset_id = f"dataset-sha256-{head.fingerprint}"
    refused = ("an empty dataset may not be published" if not total.row_count else
               "data reach past the as-of date" if str(total.max_trade_date) > as_of else None)
    if refused or published_run(spark, root, dataset_id):
        keyed.limit(0).write.mode("overwrite").parquet(path)
        if refused:
            raise DatasetError(refused)
        return dataset_id
    if evidence:
        tables = {}
        for name, table in evidence.items():
            place = f"{root}/evidence/{dataset_id}/{run}/{name}"
            table.write.mode("errorifexists").parquet(place)
            tables[name] = (spark.read.schema(table.schema).parquet(place), table.columns)
        auxiliary_index(tables, dataset_id).write.mode("errorifexists").parquet(
            f"{root}/evidence/{dataset_id}/{run}/index")
    whole = {"dataset_id": dataset_id, "file_count": stats.count(), "dataset_family": dataset_family,
             "normalization_version": normalization_version, "as_of": as_of, "source": source,
             "source_version": source_version, "generated_at": generated_at,
             "fingerprint": head.fingerprint}
    manifest = stats.select(*[
        (F.lit(whole[f.name]) if f.name in whole else F.col(f.name)).cast(f.dataType).alias(f.name)
        for f in MANIFEST if f.name != "run"])
    manifest.write.mode("errorifexists").parquet(f"{root}/manifests/{dataset_id}/run={run}")
    return dataset_id


def published_run(spark: SparkSession, root: str, dataset_id: str) -> str | None:
    """The run of least name whose manifest holds all its rows; none if there is none."""
    try:
        every = spark.read.schema(MANIFEST).parquet(f"{root}/manifests/{dataset_id}")
    except AnalysisException:  # no such folder
        return None
    runs = every.groupBy("run").agg(F.count("*").alias("n"), F.max("file_count").alias("of"))
    return runs.where("n = of").agg(F.min("run")).first()[0]


def read_manifest(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    """One row per file, of one run if several published the same content."""
    run = published_run(spark, root, dataset_id)
    if run is None:
        raise DatasetError(f"{dataset_id} is not published")
    every = spark.read.schema(MANIFEST).parquet(f"{root}/manifests/{dataset_id}")
    return every.where(F.col("run") == run)


def load_dataset(spark: SparkSession, root: str, dataset_id: str,
                 as_of: str | None = None) -> DataFrame:
    """Bars of a published dataset after checking its files against its manifest and its id."""
    manifest = read_manifest(spark, root, dataset_id)
    head = manifest.first()
    if as_of is not None and as_of > str(head.as_of):
        raise DatasetError("cannot read past the as-of date of the dataset")
    bad = verify_files(spark, root, dataset_id).where("size(codes) > 0").take(1)
    if bad:
        raise DatasetError(f"{bad[0].path}: {', '.join(bad[0].codes)}")
    identity = {"family": head.dataset_family, "normalization": head.normalization_version,
                "as_of": str(head.as_of), "source": head.source,
                "source_version": head.source_version}
    if f"dataset-sha256-{_named(merged(manifest), identity).first().fingerprint}" != dataset_id:
        raise DatasetError("dataset fingerprint mismatch")
    last = F.lit(as_of or str(head.as_of)).cast("date")
    stored = spark.read.schema(STORED).parquet(f"{root}/datasets/{head.run}")
    return stored.where((F.col("trade_date") <= last) & (F.col("year") <= F.year(last))).select(
        *BARS.names)


#: Statistics that may be compared, with the code of a difference.
CHECKED = {"row_count": "ROW_COUNT_MISMATCH", "min_trade_date": "MIN_DATE_MISMATCH",
           "max_trade_date": "MAX_DATE_MISMATCH", "file_size": "SIZE_MISMATCH",
           "digest": "DIGEST_MISMATCH"}


def mismatch_codes(stats: Sequence[str]) -> Column:
    """Codes of one file whose observed values (o_) differ from the declared ones (d_)."""
    return F.array_compact(F.array(
        F.when(F.col("d_row_count").isNull(), "UNDECLARED_FILE"),
        F.when(F.col("o_row_count").isNull(), "MISSING_FILE"),
        *[F.when(~F.col(f"o_{c}").eqNullSafe(F.col(f"d_{c}")), CHECKED[c]) for c in stats],
        F.when(F.col("o_max_trade_date") > F.col("as_of"), "PAST_AS_OF")))


def verify_dataset(observed: DataFrame, declared: DataFrame, as_of) -> DataFrame:
    """Declared against observed statistics, one row per file with its mismatch codes.

    Compares row_count, min_trade_date and max_trade_date, and file_size and digest where both
    sides have them.
    """
    stats = [c for c in CHECKED if c in observed.columns and c in declared.columns]
    left = observed.select("path", *[F.col(c).alias(f"o_{c}") for c in stats])
    right = declared.select("path", *[F.col(c).alias(f"d_{c}") for c in stats])
    joined = left.join(right, "path", "full").withColumn("as_of", F.lit(str(as_of)).cast("date"))
    return joined.select("path", F.col("o_row_count").alias("row_count"),
                         mismatch_codes(stats).alias("codes"))


def _digested(stats: DataFrame) -> DataFrame:
    return stats.withColumn("digest", F.sha2(F.concat_ws("|", *SUMS), 256))


def verify_files(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    """Every file that is stored or declared, with its mismatch codes: a damaged, missing or added
    file is named."""
    manifest = read_manifest(spark, root, dataset_id)
    head = manifest.first()
    observed = file_stats(spark, f"{root}/datasets/{head.run}")
    return verify_dataset(_digested(observed), _digested(manifest), head.as_of)


def verify_years(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    """The same one level up the digest tree: the rows of a year, whatever files hold them."""
    manifest = read_manifest(spark, root, dataset_id)
    head = manifest.first()
    year = F.substring_index("path", "/", 1).alias("path")
    observed, declared = (
        _digested(merged(stats, year))
        for stats in (file_stats(spark, f"{root}/datasets/{head.run}"), manifest))
    return verify_dataset(observed, declared, head.as_of)


def pk_order(spark: SparkSession, path: str) -> DataFrame:
    """One row per file under ``path``: rows, keys not above the key before (``inversions``), and
    whether its first key is not above all keys of the files before it in its folder.

    A file's rows are read in their stored order, which is one task's work; folders then compare
    first and last keys, one row per file.
    """
    stored = spark.read.schema(STORED).parquet(path)
    parts = F.split("_metadata.file_path", "/")
    rows = stored.select(
        F.concat_ws("/", F.slice(parts, -2, 2)).alias("path"), F.element_at(parts, -2).alias(
            "folder"), F.col("_metadata.row_index").alias("at"), F.struct(*PRIMARY_KEY).alias("key"))
    before = F.lag("key").over(Window.partitionBy("path").orderBy("at"))
    files = rows.withColumn("before", before).groupBy("folder", "path").agg(
        F.count("*").alias("row_count"), F.count_if(F.col("key") <= F.col("before")).alias(
            "inversions"), F.min("key").alias("low"), F.max("key").alias("high"))
    earlier = Window.partitionBy("folder").orderBy("low", "high", "path").rowsBetween(
        Window.unboundedPreceding, -1)
    return files.select("path", "folder", "row_count", "inversions", F.coalesce(
        F.col("low") <= F.max("high").over(earlier), F.lit(False)).alias("overlaps"))


def auxiliary_index(evidence: Mapping[str, tuple[DataFrame, Sequence[str]]],
                    dataset_id: str) -> DataFrame:
    """Digest and size of each evidence table, kept apart from the dataset's manifest."""
    parts = []
    for name, (table, columns) in sorted(evidence.items()):
        text = [F.col(c).cast("string") for c in columns]
        parts.append(dataset_fingerprint(table, text, {"table": name}).select(
            F.lit(dataset_id).alias("dataset_id"), F.lit(name).alias("path"), "row_count",
            "fingerprint"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
