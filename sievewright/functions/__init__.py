"""Column expressions over text, and the rule tables they take."""
