"""Corporate-filings analytics expressed as Spark DataFrame transformations."""
