"""Seat-allotment analytics and training-data operators as PySpark DataFrame jobs."""
