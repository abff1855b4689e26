"""Text features, one-vs-rest classifiers and their scores."""
