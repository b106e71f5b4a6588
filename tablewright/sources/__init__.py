"""Readers. Each returns a lazy DataFrame; files are split over tasks where the format allows."""
