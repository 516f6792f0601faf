"""The registered queries over the test tables."""
