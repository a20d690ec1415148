"""Operators over signal DataFrames: point-wise, analysis, alignment, windows, folds, packets, frames."""
