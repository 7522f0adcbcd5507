"""Queries registered for the check tool: every operator applied to the driver tables."""
