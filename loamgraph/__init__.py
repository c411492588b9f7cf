"""Analytics over a typed code graph and its knowledge store, as Spark DataFrame plans."""
