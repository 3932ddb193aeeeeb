"""Operators of a training-text pipeline; nothing outside this subpackage imports it."""
