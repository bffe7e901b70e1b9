"""Small tables with the awkward rows that every operator must take."""

LONG = "the quick brown fox jumps over a lazy dog and runs away " * 3000


def documents(spark, rows, extra=True):
    """(doc_id, text) rows as a documents table; extra columns clash with names the operators use inside."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        for name in ("score", "label", "ids", "bands", "block", "hash", "kept", "n", "tail", "spans"):
            df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame([], schema)


def rows_of(df, *columns):
    """Rows as sorted tuples; nulls first."""
    return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=lambda r: tuple((v is not None, v) for v in r))
