"""Functions of strandline."""
