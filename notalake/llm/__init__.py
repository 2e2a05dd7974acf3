"""Operators for building training corpora: thirteen operators, each with a registered query over its whole table."""
