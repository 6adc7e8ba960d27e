"""Multi-source time-series datasets on Spark: align, label, split, scale, window and verify."""
