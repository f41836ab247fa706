"""tidemark: error, log and trace-event analytics on Spark."""
