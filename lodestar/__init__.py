"""Funding-intelligence analytics and corpus preparation on PySpark."""
