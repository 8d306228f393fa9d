"""Operators for preparing training text: quality, repeats, secrets, pages, tokens, mixtures, toxicity, leaks."""
