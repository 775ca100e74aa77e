"""pagelens: website-audit and corpus analytics as ordinary Spark plans."""
