"""Analytics for conversational and voice-agent data on Spark DataFrames."""
