"""Set-based operators: DataFrames in, one lazy DataFrame out."""
