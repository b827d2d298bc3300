"""siltstone: a PySpark-native engine over text, event ledgers and manifests."""
