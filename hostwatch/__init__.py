"""Analytics over certificate-derived hostnames as Spark DataFrame operators and streams."""
