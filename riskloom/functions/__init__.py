"""Column-expression helpers (all Catalyst expressions, no Python UDFs)."""

from .expressions import *  # noqa: F401,F403
