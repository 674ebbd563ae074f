"""Whole models, composed of operators."""
