"""Operators on texts for training corpora: leaked test items, source mixtures, shared spans."""
