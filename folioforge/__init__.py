"""folioforge: brokerage and company-fundamentals analytics as Spark DataFrame operators.

Every public operator takes DataFrames (or Columns) and returns a lazy DataFrame (or Column) that
covers all accounts and symbols at once.
"""

__version__ = "0.1.0"
