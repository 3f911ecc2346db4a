"""Training-data operators: extraction, scoring, filtering and deduplication
of text and vector tables. Nothing else in the library imports this package."""
