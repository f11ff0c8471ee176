"""Change feeds, live views and replication."""
