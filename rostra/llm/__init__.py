"""Operators that prepare text and annotations for language models. Nothing outside this subpackage imports it."""
