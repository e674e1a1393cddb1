"""Readers and writers of the file forms the workloads use."""
