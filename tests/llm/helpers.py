import duckdb
import public_tokenizers

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, parts=3):
    """A documents table of (doc_id, text[, lang, source]) rows, with an extra column of a clashing name."""
    full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), None if r[1] is None else len(r[1]), "x", 1, 2.5) for r in rows]
    return spark.createDataFrame(full, DOCS + ", rank string, size int, score double").repartition(parts)


def table(spark, name, sf="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")


def duck_over(**frames):
    connection = duckdb.connect()
    for name, df in frames.items():
        connection.register(name, df.toArrow())
    return connection


def as_rows(arrow):
    names = sorted(arrow.column_names)
    return names, sorted(zip(*[arrow.column(n).to_pylist() for n in names]), key=repr)


ODD_ROWS = [(1, None), (2, ""), (3, " \t\n\x0b\r "), (4, "one"), (5, "two words"), (6, "漢字 ß é　x"), (7, "a " * 30_000), (8, "a " * 30_000), (9, "q" * 5000), (None, "no id here at all"), (10, "same row"), (10, "same row"), (11, None, None, None), (12, "zero\x00byte \x85  ")]
