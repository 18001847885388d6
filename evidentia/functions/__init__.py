"""Column functions: text, URLs, trust, dates and vectors. All are compositions of built-in expressions."""
