"""relaytrace: a Spark-native engine for LLM-agent call logs.

Raw API-call records are ingested (batch or stream), attributed to task
runs, prefix-deduplicated per session, replayed to mark generated turns,
converted to one nested conversation schema, and scored from judge
verdicts.  Every operator is ``DataFrame -> DataFrame``; nothing is
collected on the driver.
"""

__version__ = "0.1.0"
