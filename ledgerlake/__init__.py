"""Double-entry ledger analytics as Spark DataFrame transformations."""
