"""Column functions: codecs of stored columns, and structures that users define."""
