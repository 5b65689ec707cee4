"""Spark jobs for periodic regulatory filings.

Every public function takes and returns DataFrames (or Columns) and stays lazy; sinks are the only place
where an action runs.
"""
