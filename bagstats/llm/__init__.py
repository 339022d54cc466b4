"""Operators for preparing language-model training data.

Nothing else in the package imports this folder.  Each module is one operator;
``queries`` registers the query of each and of the pipeline.
"""
