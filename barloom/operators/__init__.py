"""Relational operators on records, bars, days and partitions."""
