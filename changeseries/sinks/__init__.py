"""Writers. Results are DataFrames; nothing is written unless one of these is called."""
