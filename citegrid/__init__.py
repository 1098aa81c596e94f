"""Checking of legal citations over tables of documents, on Spark."""
