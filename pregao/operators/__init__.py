"""The steps from a raw ledger to its result tables."""
