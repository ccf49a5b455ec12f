"""Operators of a training-data pipeline; nothing else in ionframe imports this subpackage."""
