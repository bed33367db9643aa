"""Batch operators over the transaction table."""
