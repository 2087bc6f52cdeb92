"""Encaje: structure candidate documents and job postings, and match them, on Spark."""
