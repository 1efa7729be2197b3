"""Text and event analytics on Spark: the names that most callers need; the rest is in the subpackages."""

from .jobs import Job, Registry
from .operators.parsers import format_of, parsed
from .operators.reports import consolidation_report, formatted, json_report, markdown_report, text_report
from .operators.saliency import bucket, distribution, heuristic, heuristics, with_context_bonus, with_salience

__all__ = [
    "Job", "Registry", "bucket", "consolidation_report", "distribution", "format_of", "formatted", "heuristic", "heuristics", "json_report", "markdown_report", "parsed",
    "text_report", "with_context_bonus", "with_salience",
]
