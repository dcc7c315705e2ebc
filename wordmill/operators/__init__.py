"""operators of the text-mining engine."""
