"""Operators for preparing training data: near copies, quality, toxicity, packing and more."""
