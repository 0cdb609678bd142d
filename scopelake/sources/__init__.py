"""Stores: where tables, logs and bookkeeping are read from and written to."""
