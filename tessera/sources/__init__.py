"""Readers, sinks and the proxy tables over the test data."""
