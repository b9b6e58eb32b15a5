"""marketlens: listing-market analytics expressed as Spark DataFrame programs."""
