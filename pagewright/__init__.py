"""Pagewright: document analytics as Spark DataFrame operators."""
