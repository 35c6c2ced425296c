"""Composite jobs: the three products and the batch jobs that feed them."""
