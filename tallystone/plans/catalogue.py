"""Every registered query, by family."""

from tallystone.plans import q_reports, q_import, q_investigate, q_labels, q_scenario, q_logs, q_sources, q_streams  # noqa: F401
from tallystone.plans.registry import ORACLES, QUERIES  # noqa: F401
