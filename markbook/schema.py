"""Explicit schemas of the tables the engine reads and writes."""

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


def bank_schema(choices=("A", "B", "C", "D")) -> T.StructType:
    """Question bank: ``row_idx`` gives the order that "first k rows" needs."""
    return T.StructType(
        _strings("subject", "split")
        + [T.StructField("row_idx", T.LongType())]
        + _strings("question", *choices, "answer", "explanation")
    )


SUBJECTS = T.StructType(_strings("subject", "name", "category"))
HIERARCHY = T.StructType(_strings("category", "supercategory"))
TEMPLATES = T.StructType(
    [T.StructField("file_order", T.IntegerType())]
    + _strings("model_name", "system_token", "end_token", "assistant_token", "user_token")
)
LEDGER = T.StructType(_strings("model", "subject") + [T.StructField("accuracy", T.DoubleType())])
GENERATED = T.StructType(
    _strings("response", "status") + [T.StructField("attempts", T.IntegerType())] + _strings("error")
)
