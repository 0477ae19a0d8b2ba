"""queuelens: analytics and run-time prediction over batch-cluster job logs, on Spark."""
