"""Pagewright: document enrichment and hybrid retrieval as PySpark DataFrame plans."""
