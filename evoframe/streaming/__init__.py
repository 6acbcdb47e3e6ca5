"""Folds over time-ordered rows, in batch and as stateful streams."""
