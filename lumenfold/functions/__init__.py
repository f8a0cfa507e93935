"""See README.md for the operators held here."""
