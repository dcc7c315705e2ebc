"""plans of the text-mining engine."""
