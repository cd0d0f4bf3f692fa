"""Whole jobs: the job description and the run that follows it."""
