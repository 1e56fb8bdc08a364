"""Fraud-text analytics as Spark DataFrame operators.

Every public function takes DataFrames (or Columns) and returns DataFrames (or Columns); nothing here
runs outside Spark except the small numpy kernels that Arrow batches pass through in ``operators.vectors``.
"""
