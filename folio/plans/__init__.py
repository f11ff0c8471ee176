"""The registered queries, each with SQL of the same meaning."""
