"""Readers of job data: hosts, event logs, workflow logs, training logs, resource monitor files."""
