"""Scans, sinks and the mapping from the driver's tables to domain tables."""
