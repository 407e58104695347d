import os

import duckdb
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
OWN_NAMES = ("keep_id", "kept", "fp", "_row", "_size", "_copies", "component_id", "size", "shard", "_id", "_key", "key",
             "ids", "n_tokens", "score", "lang_pred", "edited", "range", "known_digest", "license_id", "_part", "bucket")


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, lang[, source]]) tuples, dealt over several partitions."""
    def make(rows, parts=3):
        full = [tuple((tuple(r) + (None, None))[:4]) + (len(r[1]) if r[1] else None,) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)
    return make


@pytest.fixture(scope="session")
def clashing():
    """Adds columns whose names the operators use for their own."""
    def add(df):
        for c in OWN_NAMES:
            df = df.withColumn(c, F.lit("clash"))
        return df
    return add


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def in_duckdb():
    """Rows of SQL over ``documents`` given as a file or as tuples."""
    def run(sql, rows=None):
        con = duckdb.connect()
        if rows is None:
            con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
        else:
            con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
            for r in rows:
                con.execute("INSERT INTO documents VALUES (?, ?, ?, ?)", list((tuple(r) + (None, None))[:4]))
        cur = con.execute(sql)
        names = [c[0] for c in cur.description]
        return [dict(zip(names, r)) for r in cur.fetchall()]
    return run


@pytest.fixture(scope="session")
def same_rows():
    def check(got, want):
        def key(rows):
            return sorted([tuple(sorted((k, str(v)) for k, v in r.items())) for r in rows])
        assert key([r.asDict() if hasattr(r, "asDict") else r for r in got]) == key(want)
    return check


os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")
