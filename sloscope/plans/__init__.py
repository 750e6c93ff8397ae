"""Composite views made of the operators."""
