"""Spark-native code knowledge graph engine."""

TOOL_VERSION = "0.1.0"
#: Layout version of the snapshot store; a store with another one is reported as incompatible.
STORE_VERSION = 3
#: Version of the JSON envelope that agent queries return.
ENVELOPE_VERSION = "1.0"
