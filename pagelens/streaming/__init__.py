"""Scheduling and resumable work, as columns and as streams."""
