"""Spark jobs for longitudinal studies with sampled signals."""
