"""Whole workloads composed from operators."""
