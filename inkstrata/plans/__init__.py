"""Workflow configuration and the queries over the test tables."""
