"""Time-series panel analytics expressed as Spark DataFrame and Column logic."""
