"""Operators for training text: tokenization, duplicates, defects, subsets, mixing and residue."""
