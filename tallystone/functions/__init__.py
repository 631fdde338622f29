"""Part of tallystone."""
