"""Pipelines and read queries composed of the operators."""
