"""Topics, text lines, framed records, schema catalogues and stored results as DataFrames."""
