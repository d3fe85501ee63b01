"""Operators on text corpora for training data: each module holds one operator."""
