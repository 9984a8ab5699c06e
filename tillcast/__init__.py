"""Retail sales analytics, demand forecasting and replenishment on Spark."""

__version__ = "0.1.0"
