"""Analytics over series of market bars, as Spark jobs."""
