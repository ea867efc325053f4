"""Registered queries: names, and a sample of them next to their SQL twins."""

import subprocess
import sys

import pytest

from tallyloom.plans.catalog import all_oracles, all_queries
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "flagship", "src_calls", "src_mdtable", "msg_prep", "agg_context", "agg_spend", "adv_top", "scan_suppress", "doc_corpus",
    "tsk_candidates", "tsk_dedup", "tsk_merge", "mod_assign", "est_calib", "lvl_load", "snk_upsert", "str_usage",
]


def test_every_twin_belongs_to_a_query():
    assert set(all_oracles()) <= set(all_queries())
    assert set(all_queries()) == set(all_oracles())


def test_importing_needs_no_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and len(e.oracle_sql()) > 100"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_twin(spark, con, name):
    ok, note = compare(all_queries()[name](spark, SF).toArrow(), con, all_oracles()[name])
    assert ok, note
