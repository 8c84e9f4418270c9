"""Query plans: report dispatch and the registry of named queries with their oracle SQL."""
