"""Column expressions: clocks, class strings, safe arithmetic, spectra held as arrays."""
