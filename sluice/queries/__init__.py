"""Named queries over the test tables, each with its equal in plain SQL."""
