"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. It needs PySpark, Arrow,
numpy and pandas, and, for tokenizers, regex, ahocorasick and sentencepiece.
"""
