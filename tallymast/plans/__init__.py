"""Plan shapes shared by the operators: skew-safe neighbours, sliding counts, band joins."""
