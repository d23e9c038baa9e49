"""The analytics operators, one module per subject."""
