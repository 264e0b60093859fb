"""Corpus operators for training-data pipelines. Nothing else imports this package."""
