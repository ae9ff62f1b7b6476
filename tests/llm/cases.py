"""A small table of documents with every awkward case, and a frame of it with clashing extra columns."""

BASE = "the quick brown fox jumps over the lazy dog while seven wizards boil strange green soup near an old river mill at dawn"
NEAR = BASE.replace("strange", "unusual")
LINE = "this notice was printed at page 12 of the daily bulletin for all readers"
LONG_LINE = " ".join(f"passage word{'abcdefghijklmnopqrstuvwxyz'[i % 26]} {'abcdefghijklmnopqrstuvwxyz'[i // 3 % 26]}x" for i in range(30))
ROWS = [
    (1, BASE), (2, BASE), (3, NEAR), (4, None), (5, ""), (6, "   \n\t "), (7, "one"), (8, "one two"), (9, "One  two"), (9, "One  two"),
    (None, BASE), (None, None), (10, "word " * 40000), (11, "é" * 5000 + "\n" + LONG_LINE), (12, "first\n" + LONG_LINE + "\nlast"),
    (13, LINE + "\nalpha"), (14, LINE.replace("12", "77") + "\nbeta"), (15, "gamma\n" + LINE.replace("12", "9")), (16, "<|endoftext|> a  <|endoftext|>"),
    (17, "\x00 \x01 \x1f odd ​ marks"), (18, "### $$$ %%% " * 30), (19, "SHOUT!! NOW!! " * 20), (20, "you are an idiot and a moron " * 3),
]
SCHEMA = "doc_id long, text string"


def documents(spark, rows=None):
    """With columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
    extra = {c: F.lit(None).cast("string") for c in ("lang", "source")}
    return df.withColumns(extra | {"n_chars": F.length("text").cast("long"), "score": F.lit(7), "media": F.lit("m"), "key": F.lit(1), "ids": F.lit(2), "n": F.lit(3), "rank": F.lit(4)})


def empty(spark):
    return documents(spark, [])
