"""streaming of the text-mining engine."""
