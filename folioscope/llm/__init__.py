"""Operators for training data at scale. Nothing else in folioscope imports this subpackage."""
