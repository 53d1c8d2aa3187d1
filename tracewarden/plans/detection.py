"""Events -> final alerts: every detector, one cooldown, evidence and narrative."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tracewarden.operators import correlate as c
from tracewarden.operators import entities as e
from tracewarden.operators.narrative import five_w, five_w_fields
from tracewarden.operators.running import HOT_ROWS, measured
from tracewarden.operators.sigma import RulePack, sigma_match
from tracewarden.session import written


def candidates(
    events: DataFrame, pack: RulePack | None = None, window_s: int = 600, hosts: int = 3, entity: dict | None = None,
    hot_rows: int = HOT_ROWS, **rules,
) -> DataFrame:
    """Candidate alerts of all detectors, in the order in which one event is examined (column ``stage``).

    ``entity`` holds arguments of entities.deviations, ``rules`` those of correlate.correlate.
    """
    pack = RulePack.builtin() if pack is None else pack
    return (
        e.deviations(events, hot_rows=hot_rows, **(entity or {}))
        .unionByName(sigma_match(events, pack))
        .unionByName(c.correlate(events, window_s, hosts=hosts, hot_rows=hot_rows, **rules))
        .unionByName(e.entity_lateral(events, window_s, hosts, hot_rows=hot_rows))
    )


def prepared(events: DataFrame, hot_rows: int = HOT_ROWS):
    """The events as a table of their own, and ``hot_rows`` with the hot keys of the detectors."""
    events = written(events)
    return events, measured(events, hot_rows, ["actor"], ["source"], ["actor", "source"])


def detect(
    events: DataFrame, pack: RulePack | None = None, window_s: int = 600, cooldown_s: int = 300, hosts: int = 3,
    entity: dict | None = None, hot_rows: int = HOT_ROWS, **rules,
) -> DataFrame:
    """Final alerts. The survivors of the cooldown are written: they feed several later steps.

    Repeated event ids count once; events without one get an id from their content. What the detectors read is written once as a table, so the input is parsed once and each
    scan reads its own columns. The keys that windows are kept by are counted once.
    """
    events, hot_rows = prepared(c.identified(c.unique_events(events)), hot_rows)
    found = candidates(events, pack, window_s, hosts, entity, hot_rows, **rules)
    return c.finalise(c.cooldown(found, cooldown_s, hot_rows), events, window_s, hot_rows)


def investigate(events: DataFrame, as_of, fields: dict[str, str] | None = None, **options) -> DataFrame:
    """Final alerts with their narratives, or only with the ``fields`` of them that are named, see ``five_w_fields``."""
    alerts = detect(events, **options)
    return five_w(alerts, as_of) if fields is None else five_w_fields(alerts, as_of, fields)
