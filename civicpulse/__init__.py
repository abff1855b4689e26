"""Ticket and air-quality analytics as Spark jobs."""
