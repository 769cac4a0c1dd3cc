"""Landing raw inputs as typed tables: dimensions, request manifests, nested
JSON responses, gridded files with time in the file name, CSV (S1-S9, S11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def inline_table(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """A literal dimension table (a few rows, size fixed by the caller)."""
    return spark.createDataFrame(list(rows), schema)


def empty_like(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    """An empty table with the right schema (no NA seed row)."""
    return spark.createDataFrame([], schema)


def split_site_id(site_id: str | Column, sep: str = "-") -> dict[str, Column]:
    """``SS-CCC-NNNN`` → state, county and site code columns."""
    c = F.col(site_id) if isinstance(site_id, str) else site_id
    return {
        "state_code": F.split_part(c, F.lit(sep), F.lit(1)),
        "county_code": F.split_part(c, F.lit(sep), F.lit(2)),
        "site_code": F.split_part(c, F.lit(sep), F.lit(3)),
    }


def request_manifest(entities: DataFrame, id_col: str, begin_year: str, end_year: str,
                     year_col: str = "pull_year") -> DataFrame:
    """One request row per entity and calendar year in [begin, end].

    ``explode(sequence(b, e))`` replaces the reference's replicate-then-count
    loop; begin/end date strings use the API's ``yyyyMMdd`` form.
    """
    y = F.col(year_col)
    return (entities
            .withColumn(year_col, F.explode(F.sequence(F.col(begin_year).cast("int"), F.col(end_year).cast("int"))))
            .withColumns(split_site_id(id_col))
            .withColumn("bdate", F.concat(y.cast("string"), F.lit("0101")))
            .withColumn("edate", F.concat(y.cast("string"), F.lit("1231"))))


def response_schema(header: T.StructType, data: T.StructType) -> T.StructType:
    """Shape of one API response: ``{Header: [struct], Data: [struct]}``."""
    return T.StructType([
        T.StructField("Header", T.ArrayType(header)),
        T.StructField("Data", T.ArrayType(data)),
    ])


def flatten_response(df: DataFrame, header_col: str = "Header", data_col: str = "Data",
                     keep: Sequence[str] = ()) -> DataFrame:
    """S3: recycle the one-row header onto every data row (``unnest(c(Header, Data))``).

    Header fields get a ``header_`` prefix so they never clash with data fields
    (the reference auto-suffixes clashes; we rename explicitly).  A response without
    a header row gives null header fields, one without data gives no rows.
    """
    hdr_fields = df.schema[header_col].dataType.elementType.fieldNames()
    hdr = [F.col("_h")[f].alias(f"header_{f}") for f in hdr_fields]
    return (df.select(*keep, F.get(header_col, F.lit(0)).alias("_h"), F.col(data_col))
              .select(*keep, *hdr, F.inline(F.col(data_col))))


def read_responses(spark: SparkSession, path: str, schema: T.StructType, manifest: DataFrame | None = None,
                   file_key: str = "source_file") -> DataFrame:
    """Every landed response file in one multi-file scan.

    The file path (``_metadata.file_path``) identifies the request; joining the
    manifest on it restores entity and year (instead of a driver-side loop).
    """
    raw = (spark.read.schema(schema).option("multiLine", True).json(path)
           .withColumn(file_key, F.col("_metadata.file_path")))
    flat = flatten_response(raw, keep=[file_key])
    return flat if manifest is None else flat.join(manifest, file_key, "left")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with an explicit schema (never ``inferSchema`` on big inputs)."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)


def timestamp_from_name(name: str | Column, start: int, end_from_right: int, fmt: str = "yyyyMMddHH") -> Column:
    """Hour stamp embedded in a file name, e.g. ``...A20180101.0400...``.

    Takes ``str_sub(name, start, -end_from_right)``, removes the first ``.``
    and parses ``fmt``; a malformed name gives null rather than failing.
    """
    c = F.col(name) if isinstance(name, str) else name
    length = F.length(c) - F.lit(end_from_right) - F.lit(start) + F.lit(2)
    stamp = c.substr(F.lit(start), length)
    stamp = F.regexp_replace(stamp, r"^([^.]*)\.", "$1")
    return F.try_to_timestamp(stamp, F.lit(fmt)).cast("timestamp_ntz")


def read_grid_files(spark: SparkSession, path: str, schema: T.StructType | str, glob: str | None = None,
                    band_names: Sequence[str] = (), fmt: str = "parquet") -> DataFrame:
    """Decoded gridded hour files (x, y, band1..bandN) in one scan.

    Bands are renamed to variable names by position; the file name is kept
    for :func:`timestamp_from_name`.
    """
    r = spark.read.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.format(fmt).load(path).withColumn("file_name", F.col("_metadata.file_name"))
    if band_names:
        df = df.withColumnsRenamed({f"band{i + 1}": n for i, n in enumerate(band_names)})
    return df
