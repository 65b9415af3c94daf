"""Scalar building blocks as Column expressions: tokenizers, text measures, array and vector arithmetic."""
