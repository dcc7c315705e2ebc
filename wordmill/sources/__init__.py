"""sources of the text-mining engine."""
