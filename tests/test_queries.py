"""Registered queries agree with their SQL on the smallest tables, and the contract holds."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry
from tracewarden.plans import catalog

SF = "/root/testdata/sf0.001"
QUICK = [
    "event_search", "event_dashboard", "timeline_hour", "brute_force", "lateral_movement", "new_source_auth", "sigma_builtin",
    "sigma_modifiers", "entity_classify", "entity_observations", "success_after_failures", "json_events", "json_rejects",
    "validate_repairs", "windows_xml", "linux_lines", "syslog_messages", "network_events", "dedup_events", "incremental_pull", "stored_events", "stored_alerts", "content_ids", "value_markers", "alert_status", "narrative_how",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, con, name):
    assert differences(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


def test_every_query_has_sql():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
