"""maskwell: a PySpark engine that de-identifies free text at table scale."""
