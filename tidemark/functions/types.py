"""SQL Server type names and their Spark types, for reading extracts of such tables."""

from __future__ import annotations

from pyspark.sql import types as T

# The 33 SQL type names and the Spark type each is read as.
TSQL_TYPES: dict[str, T.DataType] = {
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "smallint": T.ShortType(),
    "tinyint": T.ShortType(),  # 0..255 does not fit Spark's signed byte
    "bit": T.BooleanType(),
    "decimal": T.DecimalType(18, 0),
    "numeric": T.DecimalType(18, 0),
    "float": T.DoubleType(),
    "real": T.FloatType(),
    "money": T.DecimalType(19, 4),
    "smallmoney": T.DecimalType(10, 4),
    "char": T.StringType(),
    "varchar": T.StringType(),
    "text": T.StringType(),
    "nchar": T.StringType(),
    "nvarchar": T.StringType(),
    "ntext": T.StringType(),
    "datetime": T.TimestampNTZType(),
    "datetime2": T.TimestampNTZType(),
    "smalldatetime": T.TimestampNTZType(),
    "date": T.DateType(),
    "time": T.StringType(),
    "datetimeoffset": T.TimestampType(),
    "uniqueidentifier": T.StringType(),
    "binary": T.BinaryType(),
    "varbinary": T.BinaryType(),
    "image": T.BinaryType(),
    "xml": T.StringType(),
    "timestamp": T.BinaryType(),
    "rowversion": T.BinaryType(),
    "sql_variant": T.StringType(),
    "geography": T.StringType(),
    "geometry": T.StringType(),
}


def extract_schema(columns: dict[str, str]) -> T.StructType:
    """Schema of a table extract from ``{column: sql type name}``; ``decimal(10,2)`` keeps its precision, ``decimal(10)`` has no places."""
    fields = []
    for name, sql_type in columns.items():
        base = sql_type.split("(")[0].strip().lower()
        if base in ("decimal", "numeric") and "(" in sql_type:
            precision, _, scale = sql_type.split("(")[1].rstrip(") ").partition(",")
            spark_type = T.DecimalType(int(precision), int(scale or 0))
        else:
            spark_type = TSQL_TYPES.get(base, T.StringType())
        fields.append(T.StructField(name, spark_type))
    return T.StructType(fields)
