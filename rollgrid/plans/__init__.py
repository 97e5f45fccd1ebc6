"""Domain views over the test tables and the registry of checkable queries."""
