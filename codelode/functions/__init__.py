"""Part of codelode."""
