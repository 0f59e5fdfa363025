"""Topics, tables, text exports and reports."""
