"""Match-footage analytics as PySpark DataFrame functions."""
