"""DataFrame operators: joins, aggregates, lookups, skew-safe windows, rating, billing, validation, maintenance."""
