"""Whole requests: from a row of options to a record of evidence."""
