"""Reading raw products: tables, instrument files, event lists, and choosing among overlapping versions."""
