"""Derived columns on Spark: declare a column, keep every row's value filled, versioned, audited and budgeted."""
