"""Analytics over AI-agent telemetry, written as Spark plans."""
