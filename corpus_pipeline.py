"""The corpus pipeline: quality, repeated lines, near-duplicates, benchmark leaks, packing. Its stages are in wiregaze.llm.pipeline."""

from wiregaze.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
