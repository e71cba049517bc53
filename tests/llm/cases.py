"""Awkward documents, and the same with extra columns whose names operators use themselves."""

LONG = " ".join(f"word{i % 997} other{i % 13}." for i in range(30_000))
ROWS = [
    (1, "The cat sat on the mat. It purred.", "en", "a", 1),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \n\t ", "fr", "b", 3),
    (5, LONG, "en", "b", 9),
    (6, "The cat sat on the mat. It purred.", "en", "a", 1),
    (7, "Le chat est sur le tapis.\nLe chat est sur le tapis.", "fr", "b", 4),
    (None, "no id at all", "en", None, 2),
    (1, "The cat sat on the mat. It purred.", "en", "a", 1),
    (8, "42 -- !!", None, "c", 8),
    (9, "É x ▁ 日本 𝒳 \x00 é", "fr", "c", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("score", "ids", "fp", "row", "word", "c", "start", "component", "_row", "_group", "length", "predicted", "accepted", "prefix", "h", "k")


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *(F.lit(f"extra {c}").alias(c) for c in CLASHES))


def collected(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


def save(docs, folder, **tables):
    for name, frame in {"documents": docs, **tables}.items():
        frame.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
