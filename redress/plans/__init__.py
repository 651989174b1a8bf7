"""Query registry (named queries + oracle SQL) and the full report."""
