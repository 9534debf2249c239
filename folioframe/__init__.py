"""Spark DataFrame operators for corpora of page-shaped records and the journals around them."""
