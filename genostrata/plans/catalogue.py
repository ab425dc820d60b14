"""All registered queries of the genomic library."""

from genostrata.plans import annotation, composition, events, intervals, matching, methylation, planning, readers, reads, scans, stored, streams, validation, validation_metrics  # noqa: F401
from genostrata.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
