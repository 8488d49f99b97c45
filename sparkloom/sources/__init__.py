"""Readers of registries, ledgers, documents, archives and event logs; writers beside them."""
