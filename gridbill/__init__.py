"""gridbill: utility metering and billing analytics on Spark (DataFrame / SQL / Structured Streaming)."""
