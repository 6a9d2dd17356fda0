"""Operators for preparing training data, each independent of the ledger part."""
