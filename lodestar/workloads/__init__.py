from lodestar.workloads import codebase, enrichment, history, listings, navigation, retrieval, sourcecode, texts, traces  # noqa: F401
from lodestar.workloads.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
