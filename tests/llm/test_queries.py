"""The bound queries: their columns, and their SQL where there is one, on the small test tables."""

import os

import duckdb
import pytest
from millrace.llm.queries import ORACLE, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
COLUMNS = {
    "op1_mixing": "doc_id size source_size target taken",
    "op2_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op3_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op4_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op5_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op6_media_columns": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op7_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op8_minhash": "doc_id class_id",
    "op9_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op10_lm_score": "doc_id held_out n_tokens n_known train_tokens base_score score",
}


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    rows = df.collect()
    table = "pages" if name == "op5_warc" else "documents"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    assert len(rows) == con.sql(f"SELECT count(*) FROM {table}").fetchall()[0][0]
    if name in ORACLE:
        told = con.sql(ORACLE[name])
        assert sorted(told.columns) == sorted(df.columns)
        order = [told.columns.index(c) for c in df.columns]
        assert sorted(repr(tuple(map(plain, r))) for r in rows) == sorted(repr(tuple(plain(r[i]) for i in order)) for r in told.fetchall())
