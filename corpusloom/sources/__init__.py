"""Reading and writing: scans, pages and ranges of tables, and sinks that are safe to repeat."""
