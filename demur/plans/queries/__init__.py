"""Registered queries, one module by operator family."""

from demur.plans.queries import fusion, prepare, rejection, selection, training  # noqa: F401
