"""Texts that every operator must take: nulls, blanks, repeats, ties, very long ones, and columns of clashing names."""

CLASH = ("uid", "id", "t", "score", "label", "kept", "key", "n", "hash", "__text", "shard", "tokens", "ids", "row", "y", "stats", "predicted", "held_out", "component_id")
LONG = "and the river went on with its long way home " * 6000


def documents(spark, extra: bool = True):
    rows = [
        (0, "The small dog went over the hill and saw a large bird near the old tree.", "en"),
        (1, None, "en"),
        (2, "", None),
        (3, "   \n\t ", "en"),
        (4, LONG, "en"),
        (5, "word", "en"),
        (6, "The small dog went over the hill and saw a large bird near the old tree.", "en"),
        (6, "The small dog went over the hill and saw a large bird near the old tree.", "en"),
        (None, "A text without a number, released under the MIT License.", "de"),
        (7, "12345 !!! ??? 678", "fr"),
        (8, "日本語 ▁ test \u0001 \u0002 x😀", "fr"),
        (9, None, None),
    ]
    rows = [(i, t, lang, "src0", len(t) if t is not None else None) for i, t, lang in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit(7).alias(c) for c in CLASH))
    return df


def sf_dir(spark, tmp_path, **tables):
    """A folder of tables; those not given are empty."""
    schemas = {
        "documents": "doc_id long, text string, lang string, source string, n_chars long",
        "labels": "doc_id long, quality int, toxic int",
        "benchmark": "item_id long, text string",
        "embeddings": "vec_id long, embedding array<float>, label int",
    }
    for name, schema in schemas.items():
        df = tables.get(name)
        (df if df is not None else spark.createDataFrame([], schema)).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
