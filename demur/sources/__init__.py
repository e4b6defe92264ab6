"""Readers, writers, generators and the run registry."""
