"""Marginalia: private marginal analytics on Spark."""
