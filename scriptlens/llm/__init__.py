"""Training-data operators (see the module docstrings for their contracts)."""
