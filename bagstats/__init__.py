"""Grouped, bag-structured data on Spark: manifests, splits, bags, scores and evaluation.

Every operator takes and returns lazy DataFrames.  Randomness is a keyed hash,
so results never depend on partitioning or on retried tasks.
"""
