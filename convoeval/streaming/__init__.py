"""Answering conversation files as they arrive."""
