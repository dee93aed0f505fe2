"""Column functions: text parsing, diagnosis rules, statistics."""
