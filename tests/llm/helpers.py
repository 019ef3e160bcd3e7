"""Fixtures of the operator tests: awkward rows and the words that the contracts speak of."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")

AWKWARD = [
    (5, "", "en", "a", 0), (None, "no id here, none at all", "en", "b", 1), (7, None, None, None, None),
    (1, "word " * 9000, "en", "a", 2), (2, "same text twice over", "fr", "b", 3), (2, "same text twice over", "fr", "b", 3),
    (3, "  leading\n\n and\t odd   space\x0b\x0c \r\n end  ", "de", "a", 4), (4, "x" * 30000, "zz", None, 5),
    (6, "<|endoftext|> a <|endoftext|>b\x00c   d\x1c e's I'll", "en", "c", 6), (8, " \n\t ", "en", "c", 7),
    (9, "É ünïcödé 😀 text́ Σ ΑΣ ßẞ 日本語 テキスト", "de", "c", 8),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=AWKWARD, extra=True):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:  # columns with the names that operators make themselves
        for name in ("start", "size", "ids", "key", "component", "n", "part", "shard"):
            df = df.selectExpr("*", f"'clash' as `{name}`")
    return df


def given(spark, name="documents", sf="0.001"):
    return spark.read.parquet(f"/root/testdata/sf{sf}/{name}.parquet")
