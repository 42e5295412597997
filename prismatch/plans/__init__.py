"""Query catalogue over the shared test tables."""
