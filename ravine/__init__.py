"""Hybrid retrieval, call analytics and corpus preparation as PySpark DataFrame plans."""
