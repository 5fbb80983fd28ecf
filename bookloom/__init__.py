"""bookloom: order-by-order market-data analytics as Spark plans."""
