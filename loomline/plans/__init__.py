"""Named queries over the project's tables, with the SQL that states the same result."""
