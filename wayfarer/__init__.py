"""Wayfarer: career analytics and text-corpus preparation as plain Spark jobs."""
