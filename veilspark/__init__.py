"""PII detection, redaction and rehydration over Spark DataFrames."""
