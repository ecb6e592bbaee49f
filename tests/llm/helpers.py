"""Small tables of documents with what every operator has to bear, written as a folder that queries can read."""

import itertools
import uuid

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank", "en", "a", 63),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, "the quick brown fox jumps over the lazy dog near the river bank", "en", None, 63),
    (4, "the quick brown fox jumps over the lazy dog near the river bank", "en", None, 63),
    (5, " \n\t  ", "fr", "b", 6),
    (6, "ünïcödé 日本語 \U0001f600 text with odd blanks <|endoftext|> x", None, "b", 40),
    (7, "word " * 30000, "en", "c", 150000),
    (None, "a document without id", "en", "a", 21),
    (8, "one", "en", "zz", 3),
]


def folder(spark, tmp_path, rows=ODD, schema=SCHEMA, **tables):
    out = str(tmp_path / uuid.uuid4().hex)
    spark.createDataFrame(rows, schema).write.parquet(f"{out}/documents.parquet")
    for name, (r, s) in tables.items():
        spark.createDataFrame(r, s).write.parquet(f"{out}/{name}.parquet")
    return out


def clashing(names):
    """The odd rows with further columns, named as the operators name theirs."""
    return [(*r, *itertools.repeat("x", len(names))) for r in ODD], SCHEMA + "".join(f", {n} string" for n in names)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
