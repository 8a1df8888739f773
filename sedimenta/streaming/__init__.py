"""Change streams of tables, and event-time operators."""
