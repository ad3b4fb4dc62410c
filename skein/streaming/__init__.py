"""Streaming of skein."""
