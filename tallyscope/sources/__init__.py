"""Reading, normalising and writing ledger tables."""
