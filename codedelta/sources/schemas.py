"""Declared schemas of the stored tables, and reading with a check against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"

_STRING, _TIME = T.StringType(), T.TimestampType()


def _schema(needed: dict, optional: dict) -> T.StructType:
    return T.StructType([T.StructField(n, t, False) for n, t in needed.items()] + [T.StructField(n, t, True) for n, t in optional.items()])


CODE_PAIRS = _schema({"pair_id": _STRING}, dict.fromkeys(
    ["language", "legacy", "refactored", "legacy_type", "refactored_type", "legacy_url", "refactored_url", "legacy_ref", "refactored_ref"], _STRING)
    | {"map_hints": T.MapType(_STRING, _STRING), "include_security_scan": T.BooleanType(), "org": _STRING, "user_id": _STRING, "submitted_at": _TIME})
REQUESTS = _schema({"id": _STRING}, dict.fromkeys(["language", "legacy", "refactored", "options", "org", "user_id"], _STRING) | {"submitted_at": _TIME})
STATUS_EVENTS = _schema({"analysis_id": _STRING, "status": _STRING, "ts": _TIME}, {"seq": T.LongType(), "error_message": _STRING})
TOOL_SCORES = _schema({"group_id": _STRING, "tool": _STRING, "kpi": _STRING}, {"tool_idx": T.IntegerType(), "score": T.DoubleType()})
ORG_SETTINGS = _schema({"org": _STRING}, {"kpi_weights": T.MapType(_STRING, T.DoubleType()), "updated_at": _TIME})

#: Types that a stored column may have in place of the declared one, because they widen without loss.
_WIDENS = {("integer", "long"), ("short", "integer"), ("short", "long"), ("float", "double"), ("integer", "double"), ("timestamp_ntz", "timestamp"), ("date", "timestamp")}


class SchemaMismatch(ValueError):
    """Stored columns that contradict the declared schema."""


def differences(found: T.StructType, declared: T.StructType) -> list[str]:
    """Messages for declared columns that are missing or of a type that does not widen to the declared one."""
    have = {f.name.lower(): f.dataType for f in found.fields}
    out = []
    for f in declared.fields:
        got = have.get(f.name.lower())
        if got is None:
            out += [f'"{f.name}" is missing'] if not f.nullable else []
        elif got != f.dataType and (got.typeName(), f.dataType.typeName()) not in _WIDENS and got.simpleString() != f.dataType.simpleString():
            out.append(f'"{f.name}" is {got.simpleString()}, not {f.dataType.simpleString()}')
    return out


def conform(df: DataFrame, declared: T.StructType) -> DataFrame:
    """``df`` with the declared columns in their order and types; absent nullable ones are null, others are left out."""
    wrong = differences(df.schema, declared)
    if wrong:
        raise SchemaMismatch("; ".join(wrong))
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in declared.fields])


def read_declared(spark: SparkSession, path: str, declared: T.StructType, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """(rows, corrupt): a stored table read with its declared schema.

    Parquet carries its schema, which is compared with the declared one before any row is read.  JSON and CSV lines are read
    by the declared schema; a line that does not fit goes to ``corrupt`` as it is, with the columns that could be read; so do
    rows with null in a column that is declared not null."""
    if fmt == "parquet":
        rows = conform(spark.read.parquet(path), declared).withColumn(CORRUPT, F.lit(None).cast("string"))
    else:
        lenient = T.StructType([T.StructField(f.name, f.dataType, True) for f in declared.fields] + [T.StructField(CORRUPT, T.StringType())])
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
        # Whole records are parsed whatever columns a query asks for: a pruned column could hide that a record does not fit.
        if fmt == "json":
            rows = spark.read.text(path).select(F.from_json("value", lenient, options).alias("r")).select("r.*")
        else:
            rows = spark.read.schema(lenient).options(**options, header="true", columnPruning="false").csv(path)
    needed = [F.col(f.name).isNull() for f in declared.fields if not f.nullable]
    bad = F.col(CORRUPT).isNotNull()
    for n in needed:
        bad = bad | n
    return rows.filter(~bad).drop(CORRUPT), rows.filter(bad)
