"""Inputs: audit tables, simulated crawls, site lists, robots and sitemap files."""
