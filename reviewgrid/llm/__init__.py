"""Operators for preparing large language-model training corpora."""
