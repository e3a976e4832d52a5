"""Root-cause incidents from network syslog, as Spark DataFrame jobs."""
