"""Part of the landscape engine."""
