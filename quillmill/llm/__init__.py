"""Operators for preparing text corpora for language-model training.

Nothing else in the package imports this subpackage.  Each module holds one
operator with its own general interface; :mod:`quillmill.llm.queries` holds the
thin queries over the driver's tables.
"""
