"""Operators over DataFrames: detection, extraction, evidence, review, access, quality."""
