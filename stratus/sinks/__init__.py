"""Writers: partitioned Parquet, JDBC, any DataFrame format, and the
micro-batch sink used by the streaming jobs; result contracts."""
