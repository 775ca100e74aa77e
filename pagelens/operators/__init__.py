"""Audit operators: rules, graph measures, scores, tasks, fixes, comparisons."""
