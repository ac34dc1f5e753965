"""Line-item reconciliation operators on Spark DataFrames."""
