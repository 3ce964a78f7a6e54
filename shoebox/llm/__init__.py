"""Data-preparation operators for large-scale model training."""
