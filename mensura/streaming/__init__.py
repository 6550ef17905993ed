"""Continuous landing of records."""
