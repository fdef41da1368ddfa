"""Operators for preparing large training data sets."""
