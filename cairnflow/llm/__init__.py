"""Operators for building training corpora.  Nothing outside this subpackage imports it."""
