"""Column expressions for titles, themes, markup and labels."""
