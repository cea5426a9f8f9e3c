"""The registered queries on the small tables: columns, whole tables, and their SQL where there is some."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from tidewheel.llm import queries

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")

#: The first columns of each query, as its contract names them.
COLUMNS = {
    "op1_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op2_records": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op3_jaccard": ["doc_id", "n_shingles", "component_id"],
    "op4_substrings": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op5_digest": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op6_embeddings": ["vec_id", "n_links", "component_id", "kept"],
    "op7_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op8_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op9_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op10_pack": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
}


def test_every_operator_has_one_query():
    assert set(queries.queries()) == set(COLUMNS) and {*COLUMNS, "pipeline"} <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    df = queries.queries()[name](spark, DIR)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    rows = df.select(*COLUMNS[name]).collect()
    key, table = ("vec_id", "embeddings") if name == "op6_embeddings" else ("doc_id", "documents")
    assert {r[0] for r in rows} == {r[0] for r in con.sql(f"SELECT {key} FROM {table}").fetchall()}
    if name in queries.oracle_sql():
        want = con.sql(queries.oracle_sql()[name]).project(", ".join(COLUMNS[name])).fetchall()
        assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
