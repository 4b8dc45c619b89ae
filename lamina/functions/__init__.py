"""Part of the lamina engine."""
