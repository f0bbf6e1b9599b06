"""Bibliographic catalog and record analytics on PySpark."""
