"""Operators of skein."""
