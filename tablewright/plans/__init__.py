"""Whole workflows: dataset recipes, the preparation run, the repeated experiment."""
