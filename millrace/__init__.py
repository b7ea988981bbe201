"""Millrace: process-intelligence analytics as Spark DataFrame programs."""
