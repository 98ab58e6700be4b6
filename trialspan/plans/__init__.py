"""The plans of the engine."""
