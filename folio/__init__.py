"""folio: schema-aware document analytics on Spark DataFrames."""
