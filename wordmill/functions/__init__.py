"""functions of the text-mining engine."""
