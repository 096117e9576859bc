"""Tamper-evident, partly self-repairing block tables as Spark jobs.

Every public function takes and returns DataFrames or Columns; nothing here
starts a session, collects a table or keeps state between calls.
"""
