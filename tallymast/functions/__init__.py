"""Column-level functions: cleaning, calendar, lookups, geography."""
