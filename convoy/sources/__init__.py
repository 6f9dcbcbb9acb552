"""Readers for tables, files and topics."""
