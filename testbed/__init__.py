"""The three hospital tables and both feeds, derived from the TPC-H-like test tables."""
