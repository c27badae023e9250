"""Stateful operators: batch folds and their Structured Streaming twins."""
