"""Customer CSV files on any Hadoop file system."""

from __future__ import annotations

import csv
import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.functions.roles import target_column
from ebbtide.operators.label import label_check
from ebbtide.operators.profile import validate_table
from ebbtide.session import stage
from ebbtide.sources.records import records

# Texts read as a missing value.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
BOOLEANS = ("true", "false")

# Texts read as numbers.
WHOLE = r"^[+-]?\d+$"
DECIMAL = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)$"

CORRUPT, FILE = "_corrupt_record", "_file"
BIT_WHOLE, BIT_DECIMAL, BIT_BOOLEAN, BIT_TEXT = 1, 2, 4, 8


def _headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files by their first line; one row per file reaches the driver, as Spark's own listing does."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = lines.select(F.col("_metadata.file_path").alias("file"), place.alias("place"), "value")
    found: dict[str, list[str]] = {}
    for r in lines.groupBy("file").agg(F.min_by("value", "place").alias("head")).orderBy("file").collect():
        found.setdefault(r["head"], []).append(r["file"])
    return found


def _names(header: str) -> list[str]:
    names = [n.replace(".", "_") for n in next(csv.reader([header.lstrip("\ufeff")]))]  # a dot would read as a struct field
    if len(set(names)) < len(names) or CORRUPT in names or FILE in names:
        raise ValueError(f"column names repeat: {', '.join(names)}")
    return names


def _text_rows(spark: SparkSession, path: str, multi_line: bool, mode: str = "PERMISSIVE") -> DataFrame:
    """All cells as text, by column name whatever their order in a file. With ``multi_line``, records are cut by
    :func:`records`, so a file with line breaks inside quotes is still split among tasks.

    ``mode`` says what becomes of malformed lines: PERMISSIVE puts them into CORRUPT, DROPMALFORMED leaves them out,
    FAILFAST fails.
    """
    parts = []
    for header, files in _headers(spark, path).items():
        names = [*_names(header), *([CORRUPT] if mode == "PERMISSIVE" else [])]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        if multi_line:
            parts.append(_parsed(records(spark, files), schema, mode))
            continue
        reader = spark.read.schema(schema).option("header", True).option("escape", '"')
        reader = reader.option("mode", mode).option("columnNameOfCorruptRecord", CORRUPT)
        # with pruning on, the parser would not see how many fields a line has
        parts.append(reader.option("enforceSchema", True).option("columnPruning", False).csv(files))
    if not parts:
        raise ValueError(f"no CSV file at {path}")
    names = {c for p in parts for c in p.columns}
    for p in parts[1:]:
        if set(p.columns) != names:
            raise ValueError(f"files differ in their columns: {sorted(names - set(p.columns))} are not in all")
    return functools.reduce(DataFrame.unionByName, parts)


def _parsed(found: DataFrame, schema: T.StructType, mode: str) -> DataFrame:
    """The cells of each record; FILE, where it is wanted, is kept beside them."""
    reading = {"escape": '"', "mode": "FAILFAST" if mode == "FAILFAST" else "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "maxCharsPerColumn": "-1"}
    whole = schema if mode != "DROPMALFORMED" else T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    ddl = ", ".join(f"`{f.name}` string" for f in whole.fields)
    cells = found.select("file", F.from_csv("record", ddl, reading).alias("c"))
    if mode == "DROPMALFORMED":
        cells = cells.where(F.col(f"c.{CORRUPT}").isNull())
    kept = [F.col(f"c.`{f.name}`").alias(f.name) for f in schema.fields]
    return cells.select(*kept, *([F.col("file").alias(FILE)] if mode == "PERMISSIVE" else []))


def _value(name: str) -> Column:
    """The cell with missing-value texts as NULL."""
    return F.when(~F.col(f"`{name}`").isin(*MISSING), F.col(f"`{name}`"))


def _filled(name: str) -> Column:
    """As :func:`_value`, with blank cells as NULL too: what number and boolean parsing looks at."""
    trimmed = F.trim(_value(name))
    return F.when(trimmed != "", trimmed)


def _kind(name: str) -> Column:
    """One bit per cell for the narrowest type that fits it, 0 for a missing cell."""
    x = _filled(name)
    return (
        F.when(x.isNull(), 0)
        .when(x.rlike(WHOLE) & x.try_cast("bigint").isNotNull(), BIT_WHOLE)
        .when(x.rlike(DECIMAL) & ~x.rlike(WHOLE), BIT_DECIMAL)
        .when(F.lower(x).isin(*BOOLEANS), BIT_BOOLEAN)
        .otherwise(BIT_TEXT)
    )


def survey(text: DataFrame) -> tuple[dict[str, T.DataType], int]:
    """Narrowest type that fits every cell of a column (BIGINT, DOUBLE, BOOLEAN, else STRING), and malformed lines.

    One pass over all rows, one result row: a sample could miss the one text that makes a column a text column.
    """
    names = [c for c in text.columns if c not in (CORRUPT, FILE)]
    whole = F.col(CORRUPT).isNull()
    row = text.agg(F.count(CORRUPT).alias("malformed"), *[
        F.bit_or(F.when(whole, _kind(c)).otherwise(0)).alias(f"k{i}") for i, c in enumerate(names)
    ]).first()
    fits = {BIT_WHOLE: T.LongType(), BIT_DECIMAL: T.DoubleType(), BIT_WHOLE | BIT_DECIMAL: T.DoubleType(),
            BIT_BOOLEAN: T.BooleanType()}
    return {c: fits.get(row[f"k{i}"], T.StringType()) for i, c in enumerate(names)}, row["malformed"]


def _typed(text: DataFrame, types: dict[str, T.DataType]) -> DataFrame:
    cells = []
    for c, kind in types.items():
        source = _value(c) if isinstance(kind, T.StringType) else _filled(c)
        cell = source if isinstance(kind, T.StringType) else source.try_cast(kind)
        if isinstance(kind, T.DoubleType):
            cell = F.when(~F.isnan(cell), cell)
        cells.append(cell.alias(c))
    return text.select(*cells)


def read_csv(spark: SparkSession, path: str, types: dict[str, T.DataType] | None = None,
             multi_line: bool = False) -> DataFrame:
    """Typed customer rows of one file or all files below a folder; malformed lines are an error.

    Give ``types`` to pin the schema: then a malformed line fails the job that meets it, and no pass is needed to find
    types. ``multi_line`` allows line breaks inside quotes, at the price of reading the files twice more.
    """
    if types:
        return _typed(_text_rows(spark, path, multi_line, "FAILFAST"), types)
    found, malformed = survey(_text_rows(spark, path, multi_line))
    if malformed:
        raise ValueError(f"{malformed} malformed lines; ingest_csv leaves them out and bad_lines shows them")
    return _typed(_text_rows(spark, path, multi_line, "DROPMALFORMED"), found)


def bad_lines(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(file, line) of the lines with too few or too many fields."""
    text = _text_rows(spark, path, multi_line)
    text = text if FILE in text.columns else text.withColumn(FILE, F.input_file_name())
    kept = stage(text.where(F.col(CORRUPT).isNotNull()), "bad")
    return kept.select(F.col(FILE).alias("file"), F.col(CORRUPT).alias("line"))


def ingest_csv(spark: SparkSession, path: str, types: dict[str, T.DataType] | None = None,
               multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, checks): the typed well-formed rows and a (check, passed, detail) table that says whether they can be used."""
    found, malformed = survey(_text_rows(spark, path, multi_line))
    rows = _typed(_text_rows(spark, path, multi_line, "DROPMALFORMED"), types or found)
    well_formed = spark.range(1).select(
        F.lit("well_formed").alias("check"), F.lit(malformed == 0).alias("passed"),
        F.lit(f"{malformed} malformed lines").alias("detail"),
    )
    checks = validate_table(rows).unionByName(well_formed)
    label = target_column(rows)
    if label:
        checks = checks.unionByName(label_check(rows, label))
    return rows, checks


def write_csv(df: DataFrame, path: str) -> None:
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
