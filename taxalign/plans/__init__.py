"""Whole runs composed of operators: prepare, exemplars, alignment."""
