"""Column expressions: parsing, event tokens, texts and labels."""
