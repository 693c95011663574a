"""Structured Streaming jobs: prediction requests and questions."""
