"""Part of the shoebox engine."""
