"""Inputs: raw messages, synthetic events and the stored tables."""
