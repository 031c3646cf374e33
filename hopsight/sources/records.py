"""Strict reading: every record is accepted with its declared types or rejected with file and reason; none is lost.

Cells of text formats are read as text and cast one by one with `try_cast`, so a reject names the columns that
do not fit. `Checked.strict()` raises at the first bad record while the rows are read; `accepted` and
`rejects` split the same scan instead. No action of its own runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from hopsight.schema import TRACE, ContractError

FILE, RECORD, REASON, CORRUPT = "_file", "_record", "_reason", "_corrupt_record"
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


class RejectedRecord(ValueError):
    """Not raised by Spark itself: the text that `strict()` puts into its errors begins with this name."""


@dataclass
class Checked:
    """`judged` has the typed columns, and the file, record and reason of a reject (a null reason means accepted)."""

    judged: DataFrame

    @property
    def accepted(self) -> DataFrame:
        return self.judged.filter(F.col(REASON).isNull()).drop(FILE, RECORD, REASON)

    @property
    def rejects(self) -> DataFrame:
        """(file, reason, record)."""
        return self.judged.filter(F.col(REASON).isNotNull()).select(
            F.col(FILE).alias("file"), F.col(REASON).alias("reason"), F.col(RECORD).alias("record"))

    def strict(self) -> DataFrame:
        """The rows; whatever reads them fails on a reject. A filter, so column pruning cannot drop the check."""
        message = F.concat(F.lit(f"{RejectedRecord.__name__}: "), F.col(REASON), F.lit(" in "), F.coalesce(F.col(FILE), F.lit("?")),
                           F.lit(": "), F.substring(F.coalesce(F.col(RECORD), F.lit("")), 1, 200))
        whole = F.when(F.col(REASON).isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
        return self.judged.filter(whole).drop(FILE, RECORD, REASON)

    def write_rejects(self, path: str) -> None:
        self.rejects.write.mode("overwrite").parquet(path)


def _reason(found: list[Column]) -> Column:
    """The reasons that apply, joined; null if none does."""
    text = F.array_join(F.array_compact(F.array(*found)), "; ")
    return F.when(text != "", text)


def typed(raw: DataFrame, schema: T.StructType, record: Column, file: Column, others: list[Column] = ()) -> DataFrame:
    """`raw` with its columns cast to `schema` (columns that `schema` lacks stay), and file, record and reason.

    A cell that is null stays null; one that is not and becomes null by its cast rejects the record. `others` are more
    reasons, null where they don't apply. Columns of `schema` that `raw` lacks are left out: that is for the contract to refuse.
    """
    have = set(raw.columns)
    declared = [f for f in schema.fields if f.name in have]
    cast = {f.name: F.col(f.name).try_cast(f.dataType) for f in declared}
    bad = [F.when(F.col(f.name).isNotNull() & cast[f.name].isNull(), F.lit(f"{f.name} is no {f.dataType.simpleString()}"))
           for f in declared if raw.schema[f.name].dataType != f.dataType]
    # a whole number must not lose its fraction, nor a decimal its last places, unnoticed by the cast
    for f in declared:
        source = raw.schema[f.name].dataType
        if isinstance(f.dataType, T.IntegerType) and isinstance(source, (T.FloatType, T.DoubleType, T.DecimalType)):
            bad.append(F.when(F.col(f.name) != cast[f.name].cast(source), F.lit(f"{f.name} is no int")))
    extra = [F.col(c) for c in raw.columns if c not in cast and c not in (FILE, RECORD, REASON, CORRUPT)]
    return raw.select(*[cast[f.name].alias(f.name) for f in declared], *extra,
                      file.alias(FILE), record.alias(RECORD), _reason([*others, *bad]).alias(REASON))


def csv_records(spark: SparkSession, path: str) -> Checked:
    """A trace in CSV files with a header, columns in any order; a line with too few or too many cells is a reject."""
    names = spark.read.option("header", True).csv(path).columns
    raw = (spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in [*names, CORRUPT]]))
           .option("header", True).option("enforceSchema", False).option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    broken = F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed line"))
    cells = F.to_csv(F.struct(*[F.col(c) for c in names]))
    return Checked(typed(raw, TRACE, F.coalesce(F.col(CORRUPT), cells), F.col("_metadata.file_path"), [broken]))


def json_texts(lines: DataFrame, column: str, file: Column) -> Checked:
    """A trace from a column of JSON objects; blank lines are no records. Every declared column is present."""
    rows = lines.select(F.col(column).alias(RECORD), file.alias(FILE)).filter(F.trim(RECORD) != "")
    cells = F.from_json(RECORD, T.MapType(T.StringType(), T.StringType()), {"mode": "PERMISSIVE"})
    raw = rows.withColumn("_cells", cells).select(
        FILE, RECORD, F.col("_cells").isNull().alias("_broken"), *[F.try_element_at("_cells", F.lit(c)).alias(c) for c in TRACE.fieldNames()])
    broken = F.when(F.col("_broken"), F.lit("malformed JSON"))
    judged = typed(raw, TRACE, F.col(RECORD), F.col(FILE), [broken])
    return Checked(judged.drop("_broken"))


def json_records(spark: SparkSession, path: str) -> Checked:
    """A trace in files of one JSON object a line."""
    return json_texts(spark.read.text(path), "value", F.col("_metadata.file_path"))


def _fits(source: T.DataType, declared: T.DataType, name: str) -> bool:
    if source == declared or name == "timestamp" and isinstance(source, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return True
    return isinstance(source, _NUMBERS) and isinstance(declared, _NUMBERS)


def table_records(raw: DataFrame) -> Checked:
    """A trace in a table with types of its own: numbers are widened or narrowed cell by cell, any other type raises at once."""
    wrong = {f.name: f.dataType.simpleString() for f in raw.schema.fields
             if f.name in TRACE.fieldNames() and not _fits(f.dataType, TRACE[f.name].dataType, f.name)}
    if wrong:
        raise ContractError(f"the trace has wrong types {wrong}; expected { {c: TRACE[c].dataType.simpleString() for c in wrong} }")
    record = F.to_json(F.struct(*[F.col(c) for c in raw.columns]))
    has_file = bool(raw.inputFiles())
    return Checked(typed(raw, TRACE, record, F.col("_metadata.file_path") if has_file else F.lit(None).cast("string")))
