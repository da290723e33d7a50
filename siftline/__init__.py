"""Siftline: corpus search and text-table analytics as Spark DataFrame jobs."""
