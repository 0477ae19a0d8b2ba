"""Every registered query, with its SQL equivalent where there is one."""

from queuelens.registry import feature_queries, log_queries, model_queries, monitor_queries, stat_queries  # noqa: F401
from queuelens.registry.catalog import ORACLES, QUERIES  # noqa: F401
