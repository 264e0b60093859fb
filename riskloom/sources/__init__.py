"""Sources (transaction scans, driver-table fixtures) and sinks."""

from .transactions import (TXN_SCHEMA, SOURCE_HEADERS, read_transactions,
                           load_version, fixture_transactions, FIXTURE_TXN_SQL)
from .scores import fixture_scores, FIXTURE_SCORES_SQL, SCORE_MULTIPLIERS
