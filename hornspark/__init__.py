"""Queries and rule mining over knowledge bases of (subject, relation, object) facts, on Spark DataFrames."""
