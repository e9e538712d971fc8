"""Operators for training-data pipelines: packing, scoring, de-duplication, decontamination."""
