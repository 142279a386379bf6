"""All registered queries.  Importing the modules registers them."""

from drainwatch.catalog import calibration_queries, creator_queries, feed_queries, rule_queries, source_queries, state_queries, stream_queries  # noqa: F401
from drainwatch.catalog.registry import ORACLE, QUERIES  # noqa: F401
