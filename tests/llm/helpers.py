"""Small tables with the awkward cases, and reading of the driver's tables."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def documents(spark, texts, extra=True):
    """Rows of ``documents`` with clashing extra columns; ids in order."""
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"row": F.lit(1), "items": F.lit("x"), "n_tokens": F.lit(2), "key": F.lit("k"), "base": F.lit(0)}) if extra else df


def saved(df, folder, name="documents"):
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def as_dict(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


AWKWARD = [
    None, "", " ", "\n\t\x0b", "one", "one two", "One  two\tthree", "one two three", "a" * 5000, "word " * 4000, "ÀÉ öü ß 漢字 кириллица", "x\x85y z", "é é 　 ideographic", "same text here now", "same text here now",
]
