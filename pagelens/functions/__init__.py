"""Pure column functions and fixed dimensions."""
