"""Whole jobs, from input files to results."""
