"""Execution and resource models of a job."""
