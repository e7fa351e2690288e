"""Column builders: measures, text and dates."""
