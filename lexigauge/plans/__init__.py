"""Whole jobs: build models, apply them to questionnaires, evaluate them, and the query catalog."""
