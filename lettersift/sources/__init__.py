"""Readers and writers: raw mail, data sets, logs and state tables."""
