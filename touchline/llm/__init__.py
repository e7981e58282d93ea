"""Corpus operators for training-data preparation: filtering, scoring, matching and mixing of documents."""
