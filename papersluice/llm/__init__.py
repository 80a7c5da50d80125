"""Operators on text for training data: one form, repair, redaction, encoding, leakage, screening."""
