"""Typed inputs, partitioned outputs, intermediate tables and test-data bindings."""
