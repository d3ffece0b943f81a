"""quarry: retrieval, filed-fact, valuation and metering operators as Spark DataFrame plans."""
