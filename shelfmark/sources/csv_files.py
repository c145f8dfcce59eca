"""Typed CSV: a sink with stated tokens, and a reader that sets malformed cells and records apart instead of failing.

Written form: a header; null is an empty field and the empty string a quoted one; booleans are `t` and `f`; dates are `yyyy-MM-dd`, timestamps
`yyyy-MM-dd HH:mm:ss.SSSSSS`, decimals and numbers as Spark prints them; quotes inside a value are doubled. A value with a line break needs `lines=True` on
both sides, which keeps files from being split. Files are written and read by as many tasks as there are partitions and splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRUE, FALSE = "t", "f"
_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"
_FORM = {"header": True, "quote": '"', "escape": '"', "nullValue": "", "emptyValue": '""', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
MALFORMED, RECORD = "malformed", "record"
#: What the reader takes a quoted empty field for, as it would else be a null.
_EMPTY = "\x01empty\x01"


def _text(field: T.StructField) -> Column:
    c = F.col(field.name)
    if isinstance(field.dataType, T.BooleanType):
        return F.when(c, TRUE).when(~c, FALSE)
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, _TIME)
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        raise TypeError(f"{field.name}: a {field.dataType.simpleString()} has no CSV form")
    return c.cast("string")


def write_csv(df: DataFrame, path: str, lines: bool = False) -> None:
    texts = df.select(*[_text(f).alias(f.name) for f in df.schema])
    if not lines:
        broken = F.lit(False)
        for f in df.schema:
            if isinstance(f.dataType, T.StringType):
                broken = broken | F.coalesce(F.col(f.name).rlike(r"[\r\n]"), F.lit(False))
        texts = texts.filter(F.when(broken, F.raise_error(F.lit("a value with a line break needs lines=True"))).otherwise(F.lit(True)))
    texts.write.options(**_FORM).csv(path)


def _value(field: T.StructField) -> Column:
    c = F.col(field.name)
    if isinstance(field.dataType, T.BooleanType):
        return F.when(c == TRUE, True).when(c == FALSE, False)
    return (_shown(field) if isinstance(field.dataType, T.StringType) else c).try_cast(field.dataType)


def _shown(field: T.StructField) -> Column:
    return F.when(F.col(field.name) == _EMPTY, "").otherwise(F.col(field.name))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, lines: bool = False) -> DataFrame:
    """The columns of schema, null where a cell can't be read; `malformed`, the (column, value) of such cells and of nulls where schema allows none;
    and `record`, the text of a record with too few or too many fields (else null). A row is sound if malformed is empty and record null.

    A record that is broken as a whole has no cells to judge: its columns are null and malformed is empty."""
    asked = T.StructType([T.StructField(f.name, T.StringType()) for f in schema] + [T.StructField(RECORD, T.StringType())])
    form = {**_FORM, "emptyValue": _EMPTY, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": RECORD, "multiLine": lines, "enforceSchema": False}
    rows = spark.read.options(**form).csv(path, schema=asked)
    whole = F.col(RECORD).isNull()
    odd = [(f, F.when(whole & ((F.col(f.name).isNotNull() & _value(f).isNull()) | (F.col(f.name).isNull() & F.lit(not f.nullable))), F.struct(F.lit(f.name).alias("column"), _shown(f).alias("value")))) for f in schema]
    cells = F.filter(F.array(*[c for _, c in odd]), lambda x: x.isNotNull())
    return rows.select(*[F.when(whole, _value(f)).alias(f.name) for f in schema], cells.alias(MALFORMED), RECORD)


def sound(rows: DataFrame) -> DataFrame:
    """The rows of read_csv that can be used, without its two own columns."""
    return rows.filter(F.col(RECORD).isNull() & (F.size(MALFORMED) == 0)).drop(MALFORMED, RECORD)
