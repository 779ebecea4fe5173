"""Corvane: a document analytics and ranked-retrieval engine written as PySpark plans."""
