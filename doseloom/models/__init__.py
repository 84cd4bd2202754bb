"""Classifiers on MLlib with exact folds and exact scorers."""
