"""Ordered, labelled and attributed collections of targets on Spark."""
