"""Operators for preparing training data at scale.  Nothing else in ``lectern`` imports this subpackage."""
