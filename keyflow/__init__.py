"""Keyed tables, changelogs and ordered event sequences on Spark."""
