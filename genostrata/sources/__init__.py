"""Readers with counted reject reasons, and projections of the driver's tables."""
