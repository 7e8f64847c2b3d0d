"""Column expressions: text in, text, numbers or arrays out."""
