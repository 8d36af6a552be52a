"""Harrow: semi-structured web data into clean, provenance-carrying tables, on Spark."""
