"""Training loops and the end-to-end index."""
