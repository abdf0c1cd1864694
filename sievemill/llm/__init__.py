"""Operators for training data: pairs, near-duplicates, cuts, leaks, samples, tokens, mixtures and residue."""
