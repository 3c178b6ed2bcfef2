"""corpusforge package."""
