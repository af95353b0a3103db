"""Training-data operators: one module per operator, nothing here is imported by the search engine."""
