"""Personal-data exposure analytics expressed as Spark DataFrame plans."""
