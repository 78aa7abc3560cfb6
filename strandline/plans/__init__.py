"""Plans of strandline."""
