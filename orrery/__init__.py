"""Phenotype and disease analytics as Spark jobs."""
