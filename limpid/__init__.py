"""limpid: tabular data quality on Spark DataFrames.

Profile a table, turn the profile into issues and a cleaning plan, run the plan,
and measure what changed.  Every public function takes and returns DataFrames.
"""
