"""Veilframe: reversible masking of personal data over DataFrames of documents."""

__version__ = "0.1.0"
