"""Operators for preparing large text corpora, one module for each operator."""
