"""Storage: what files of event tables are made of."""
