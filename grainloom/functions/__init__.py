"""Column functions: cleaning, units, calendar."""
