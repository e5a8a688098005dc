"""Named queries against their SQL in DuckDB on the smallest tables, and what is registered."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry
from contract.oracle import ORACLE
from contract.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
NAMES = [
    "parse_lines", "alerts", "rule_port_scan", "incident_updates", "build_incidents", "threat_score", "attack_chain", "chain_list",
    "fp_filter", "merge_map", "merge_incidents", "rank_priority", "behaviour_findings", "ioc_relationships", "evidence",
    "matched_conditions", "observations", "graph_nodes_edges", "timeline_gaps", "notification_rollup", "auth_gap",
    "search_evidence_keyword", "dashboard_stats", "apply_incident_actions", "extract_iocs",
    "export_json", "discover_files", "list_log_files", "stream_lines",
    "stream_rate", "upsert_incidents", "publish_updates", "stream_promotions", "stream_merges", "stream_priorities", "graph_subgraph_edges",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
    assert mine == theirs


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(ORACLE) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_parts(tmp_path):
    """Without the optional subpackage and the pipeline the entry still imports, with all other queries."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), sorted(e.queries()) == sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")},
                         capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(QUERIES)), "True"]


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows[0]["count"] >= rows[-1]["count"] > 0
