"""Readers, stores and logs."""
