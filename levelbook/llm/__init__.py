"""Operators that prepare large text collections for language-model training."""
