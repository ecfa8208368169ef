"""Operators that prepare text collections for the training of language models. Nothing outside imports this package."""
