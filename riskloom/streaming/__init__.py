"""Micro-batch application of the batch operators to a transaction stream."""

from .scoring import transaction_stream, apply_per_batch
