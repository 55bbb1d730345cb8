"""Multi-stage plans."""
