"""Readers and writers for manifests, splits, patch stores, predictions and reports."""
