"""Weftline: field-mapping audits and data processing as plain Spark plans."""
