"""Multi-step work built from the operators: loads, catalog, bounded SQL, ledger."""
