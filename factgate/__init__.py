"""Governed analytics and exposure accounting on Spark."""
