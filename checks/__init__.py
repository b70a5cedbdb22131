"""Inputs and expected results used by the registered queries, tests and bench."""
