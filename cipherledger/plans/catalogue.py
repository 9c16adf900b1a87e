"""All registered queries."""

from . import registry_graph, registry_reports, registry_text  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
