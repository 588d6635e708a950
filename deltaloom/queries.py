"""One query per operator."""

from deltaloom.plans import aggregates, extensions, filters, logs, projections, routes, scalars, streams  # noqa: F401
from deltaloom.registry import QUERIES  # noqa: F401
