"""Preparation, cascade scoring and evaluation of network-flow tables on Spark."""

__version__ = "0.1.0"
