"""Settings, providers and the catalogue of queries."""
