"""passgrid: identity-screening analytics as Spark jobs.

Sub-packages: ``sources`` (tables, derived views, sinks), ``functions`` (Column
expressions), ``operators`` (DataFrame -> DataFrame jobs), ``plans`` (registered
queries with their SQL twins), ``streaming`` (Structured Streaming jobs).
"""
