"""Named queries over the shared test tables, each with its SQL statement."""

from . import aggregates, alignment, evaluation, features, ingest, models, rules, sequences, streams  # noqa: F401
from .registry import REGISTRY, oracle_statements, runnable  # noqa: F401
