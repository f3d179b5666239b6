"""Query plans: named, registered end-to-end queries and their SQL oracles."""
