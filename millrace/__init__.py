"""Millrace: a cloud-warehouse SQL dialect and its operators on Apache Spark."""
