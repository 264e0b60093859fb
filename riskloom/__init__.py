"""riskloom: transaction-risk analytics as composable Spark DataFrame operators.

Every operator is a ``DataFrame -> DataFrame`` function (usable with
``df.transform``) or a fit/apply pair whose fitted state is a handful of
scalars or a small, size-checked table.
"""

__version__ = "0.1.0"
