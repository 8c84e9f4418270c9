"""Column-expression helpers: clocks and date ranges, number/date formatting, display fallbacks."""
