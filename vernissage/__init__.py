"""Listings analytics on Spark: venues, shows and events as DataFrame jobs, tables in, tables out."""
