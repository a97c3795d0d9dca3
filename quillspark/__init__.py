"""Spark jobs for scoring question-answering experiments and for preparing training text."""
