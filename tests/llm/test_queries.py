"""What the subpackage registers, at the smallest tables."""

import pytest

import __spark_entry__ as entry
from sparkwarden.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_simhash": ["doc_id", "fingerprint", "component_id"],
    "op2_hnsw": ["query_id", "rank", "vec_id", "score"],
    "op3_resampling": ["doc_id", "log_weight", "drawn"],
    "op4_tiling": ["doc_id", "item_id", "coverage", "n_tiles", "item_words"],
    "op5_mixing": ["doc_id", "size", "source_size", "target", "taken", "slot"],
    "op6_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op7_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op8_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    "op9_url_rules": ["page_id", "host", "path", "rule", "verdict"],
    "op12_recompression": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op13_lexical": ["item_id", "rank", "doc_id", "score"],
    "op11_merkle": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    "op10_chat": ["conv_id", "turn", "role", "action", "new_role", "inserted", "cost", "piece"],
}


def test_registered():
    assert set(QUERIES) == {*COLUMNS, "pipeline"} and set(QUERIES) <= set(entry.queries())
    assert set(ORACLE) == {"op5_mixing", "op8_line_dedup", "op9_url_rules", "op12_recompression", "op13_lexical"} and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    got = entry.queries()[name](spark, SF)
    assert got.columns == COLUMNS[name]
    n = got.count()
    tables = {"op9_url_rules": "pages", "op10_chat": "conversations"}
    if name not in ("op2_hnsw", "op4_tiling", "op13_lexical"):
        assert n == spark.read.parquet(f"{SF}/{tables.get(name, 'documents')}.parquet").count()
