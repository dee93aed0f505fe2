"""Jobs that combine operators."""
