"""Registered queries against their SQL twins on the smallest tables.

``check_oracle.py`` runs all of them at any scale; here the slower whole jobs are
stood for by one each.
"""

import os

import pytest
import sys
sys.path.insert(0, os.path.dirname(__file__))
from check_oracle import compare, connect

from __spark_entry__ import oracle_sql, queries
from tallyscan.plans.oracle import ORACLES
from tallyscan.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SLOW = {"g1_escalation_queue", "g2_build_requests", "g7_overlay_semantic", "h1_merge_levels", "h2_with_confidence",
        "h3_unwrap", "h4_confidence_status", "j4_display_fields", "j5_scorecard", "i3_state_failures", "i5_state_extraction"}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables not here")


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(queries()) >= set(QUERIES) and set(oracle_sql()) >= set(ORACLES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(FOLDER), name, QUERIES[name], ORACLES[name], FOLDER) == ""
