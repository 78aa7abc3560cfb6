"""Sources of strandline."""
