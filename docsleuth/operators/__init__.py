"""Operators over tables of documents, ledgers, cases and identities."""
