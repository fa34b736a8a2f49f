"""Line, table and namespace operators as Spark DataFrame jobs."""
